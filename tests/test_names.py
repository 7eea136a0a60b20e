"""Names nearly the same, found by keys, against the score of all pairs."""

import random

from pyspark.sql import functions as F

from casewright.functions.text import normalize_name, score_pair
from casewright.operators import names


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    words = ["vikram", "vikrm", "vikrams", "sethi", "sethy", "seth", "mohan", "rohan", "v", "m", "patil", "patel", "kumar", "rao", "बल", "बाल"]
    made = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3, 4])))
    left = [(made(),) for _ in range(250)] + [("phone 12",), ("phone 13",), (None,), ("",), ("  Vikram   SETHI ",)]
    right = [(made(),) for _ in range(250)] + [("phone 12",), ("vikram sethi",), (None,)]
    a, b = spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string")
    got = {(r.a, r.b): round(r.score, 9) for r in names.name_matches(a, b).collect()}
    n = lambda df, c: df.select(normalize_name(F.col("name")).alias(c)).filter(f"{c} != ''").distinct()
    every = n(a, "a").crossJoin(n(b, "b")).withColumn("score", score_pair(F.col("a"), F.col("b"))).filter("score >= 0.55")
    want = {(r.a, r.b): round(r.score, 9) for r in every.collect()}
    assert got == want and {0.75, 0.82, 1.0} < set(want.values()) and len(set(want.values())) > 4


def test_suggestions_take_the_best_three_once_a_spelling(spark):
    have = spark.createDataFrame([("Vikram Sethi",), ("vikram sethi",), ("Vikram Patil",), ("Vikram Rao",), ("Vikram Kumar",), ("Mohan Rao",)], "name string")
    got = names.suggestions(spark.createDataFrame([(1, "vikram"), (2, "V Sethi"), (3, "nobody"), (1, "vikram")], "id long, name string"), have).collect()
    assert sorted((r.id, r.place, r.name) for r in got) == sorted([(1, 1, "Vikram Kumar"), (1, 2, "Vikram Patil"), (1, 3, "Vikram Rao")] * 2 + [(2, 1, "Vikram Sethi")])


def _blocked(spark, n: int = 90):
    rng = random.Random(12)
    words = ["vikram", "vikrm", "sethi", "sethy", "rao", "v", "7"]
    rows = [(rng.choice([1, 1, 2, None]), " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))), k) for k in rng.sample(range(500), n)] + [(1, None, 900)]
    return rows, spark.createDataFrame(rows, "block int, norm string, id long").cache()


def test_best_in_block(spark, monkeypatch):
    rows, df = _blocked(spark)
    want = set()
    for block, name, a in rows:
        others = [(-len(set(name.split(" ")) & set(o.split(" "))), o, b) for k, o, b in rows if k == block and k is not None and None not in (name, o) and a != b] if name else []
        want |= {(a, b, -less, n) for n, (less, _, b) in enumerate(sorted(others)[:3], 1)}
    plans, real = [], names.stored
    monkeypatch.setattr(names, "stored", lambda d, tag: plans.append(tag) or real(d, tag))
    got = names.best_in_block(df, ["block"], 3)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 150
    assert plans == ["first", "names"]  # names meet, not rows


def test_scored_in_block(spark, monkeypatch):
    rows, df = _blocked(spark)
    x, y = df.toDF("block", "x", "a"), df.toDF("block", "y", "b")
    every = x.join(y, "block").filter("a < b and x is not null and y is not null").select("a", "b", score_pair(F.col("x"), F.col("y")).alias("score"))
    want = sorted(tuple(r) for r in every.collect())
    for piece, pieces in ((1024, 256), (2, 3), (1, 1)):
        monkeypatch.setattr(names, "PIECE", piece)
        monkeypatch.setattr(names, "PIECES", pieces)
        assert sorted(tuple(r) for r in names.scored_in_block(df, ["block"]).select("a", "b", "score").collect()) == want
    assert len(want) > 800 and len({w[2] for w in want}) > 4


def test_names_are_scored_once_however_many_have_them(spark):
    """400 rows of two names: 79800 pairs, three scores."""
    df = spark.range(400).select(F.lit(1).alias("block"), F.when(F.col("id") % 2 == 0, "mohan rao").otherwise("mohan patil").alias("norm"), "id")
    found = names.scored_in_block(df, ["block"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") > plan.rindex("Generate explode(ix") and found.count() == 400 * 399 // 2
