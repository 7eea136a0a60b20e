"""Withholding records: what is kept from the first run and made anew equals a full second run."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import provenance as pv

NAMES = ["Vikram Sethi", "V. Sethi", "विक्रम सेठी", "Mohan Patil", "M. Patil", "Patil Mohan", "Nikhil Kumar", "Farid Kumar", "Fareed Kumar", "Gopal Jadhav", "Harish Jadhav", "Lalit Chauhan", "Tarun Sethi", "accused"]


def case(spark, seed=3, n=40):
    rng = random.Random(seed)
    obs = [(k, rng.choice(NAMES), rng.randrange(8)) for k in range(n)]
    held = [(k, f"t{rng.randrange(12)}") for k in range(0, n, 5)]
    reports = [(k, rng.randrange(n), rng.randrange(n), rng.choice([None, *range(8)]), float(rng.randrange(1, 4))) for k in range(45)]
    return (
        spark.createDataFrame(obs, "obs long, name string, record long"), spark.createDataFrame(held, "obs long, ident string"),
        spark.createDataFrame(reports, "report long, a long, b long, record long, weight double"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("out", [[2], [0, 3, 5]])
def test_without_equals_a_full_second_run(spark, out):
    tables = case(spark)
    gone = spark.createDataFrame([(k,) for k in out], "record long")
    before = pv.build(*tables)
    fast = pv.without(before, gone)
    left = [df.filter(F.col("record").isNull() | ~F.col("record").isin(out)) for df in (tables[0], tables[2])]
    full = pv.build(left[0], tables[1].join(left[0].select("obs"), "obs", "left_semi"), left[1])
    assert rows(fast.members) == rows(full.members)
    assert rows(fast.links) == rows(full.links)
    assert rows(fast.components) == rows(full.components)
    assert [(i, round(x, 9)) for i, x in rows(fast.betweenness)] == [(i, round(x, 9)) for i, x in rows(full.betweenness)]
    assert rows(pv.scores(fast)) == rows(pv.scores(full))


def test_a_shared_phone_that_goes_takes_an_identity_apart(spark):
    obs = [(1, "Vikram Sethi", 1), (2, "Mohan Patil", 2), (3, "V. Sethi", 9), (4, "Mohan Patil", 9), (5, "Gopal Jadhav", 3), (6, "Farid Kumar", 9)]
    held = [(3, "t1"), (4, "t1")]  # both numbers stand in record 9 only
    reports = [(1, 1, 5, 1, 1.0), (2, 2, 5, 9, 1.0), (3, 5, 6, 9, 1.0), (4, 2, 5, 2, 1.0)]
    before = pv.build(spark.createDataFrame(obs, "obs long, name string, record long"), spark.createDataFrame(held, "obs long, ident string"), spark.createDataFrame(reports, "report long, a long, b long, record long, weight double"))
    after = pv.without(before, spark.createDataFrame([(9,)], "record long"))
    assert rows(pv.identity_changes(before, after)) == [(1, 4, 2, 2, "split"), (6, 1, 0, 0, "gone")]
    assert rows(pv.link_changes(before, after)) == sorted([(1, 5, 3, 1, 3, 1, "weakened"), (2, 5, None, 1, None, 1, "introduced"), (5, 6, 1, None, 1, None, "removed")], key=str)
    moved = {r.id: r for r in pv.score_changes(before, after).collect()}
    assert (moved[5].degree, moved[5].degree_after) == (2, 2) and moved[6].place_after is None and not moved[1].isolated


def test_sole_grounds(spark):
    rows_ = [("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 3), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows_, "k string, record long")
    assert rows(pv.sole_grounds(df, ["k"])) == [("a", 1)]
    assert rows(pv.grounds(df, ["k"])) == [("a", 1, 2), ("b", 1, 1), ("b", 2, 1), ("c", 3, 1)]


def test_empty_case(spark):
    tables = [df.limit(0) for df in case(spark)]
    before = pv.build(*tables)
    after = pv.without(before, spark.createDataFrame([(1,)], "record long"))
    assert after.members.count() == after.links.count() == 0
