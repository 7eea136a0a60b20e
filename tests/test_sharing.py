"""Ids that share a block, counted by sets of blocks, against plain loops."""

import random

import pytest

from casewright.operators import joins as j


@pytest.mark.parametrize("most", [0, 2, 6])
def test_sharing_after(spark, monkeypatch, most):
    monkeypatch.setattr(j, "MOST_BLOCKS", most)
    rng = random.Random(8)
    rows = [(rng.randrange(60), rng.choice(["a", "b", "c", "dd", "e", "f g", "h", "k", None])) for _ in range(170)]
    of = {}
    for k, b in rows:
        of.setdefault(k, set()).add(b)
    of = {k: v - {None} for k, v in of.items()}
    want = {a: sum(b > a and bool(of[a] & of[b]) for b in of) for a in of}
    got = {r["a"]: r["n"] for r in j.sharing_after(spark.createDataFrame(rows, "id long, block string")).collect()}
    assert got == {a: n for a, n in want.items() if n} and len(got) > 40


def test_a_common_block_makes_no_pairs(spark, monkeypatch):
    plans, real = [], j.stored
    monkeypatch.setattr(j, "stored", lambda df, tag: plans.append(tag) or real(df, tag))
    got = j.sharing_after(spark.range(20000).selectExpr("id", "'x' as block"))
    assert {(r["a"], r["n"]) for r in got.filter("a % 5000 = 0 or a >= 19998").collect()} == {(0, 19999), (5000, 14999), (10000, 9999), (15000, 4999), (19998, 1)}
    assert plans == ["blocked", "subsets"]
