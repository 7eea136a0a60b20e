"""Audit chains of one and of very many entries."""

from pyspark.sql import functions as F

from casewright.operators import audit


def check(df):
    return [tuple(r)[1:] for r in audit.verified(df).orderBy("chain").collect()]


def test_chains_of_any_length(spark):
    rows = spark.range(100_000).select(F.lit("c").alias("chain"), "id", F.concat(F.lit("entry "), "id").alias("said"))
    chain = audit.appended(rows, "chain", ["id"], "said")
    assert check(chain) == [(100_000, True, None, None)]
    altered = chain.withColumn("said", F.when(F.col("seq").isin(70_001, 99_000), "other").otherwise(F.col("said")))
    assert check(altered) == [(100_000, False, 70_001, "entry")]
    assert check(chain.filter("seq != 500 and seq != 501")) == [(99_998, False, 502, "previous")]
    hidden = altered.withColumn("hash", F.when(F.col("seq") == 70_001, audit.entry_hash(F.col("seq"), F.col("said"), F.col("prev_hash"))).otherwise(F.col("hash")))
    assert check(hidden) == [(100_000, False, 70_002, "previous")]  # hashed anew, but the next entry knows better


def test_one_entry_appends_and_empty_chains(spark):
    one = audit.appended(spark.createDataFrame([("a", 1, None)], "chain string, id long, said string"), "chain", ["id"], "said")
    assert check(one) == [(1, True, None, None)] and one.first().prev_hash == audit.GENESIS
    more = audit.appended(spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), (None, 1, "z")], "chain string, id long, said string"), "chain", ["id"], "said", one)
    both = one.unionByName(more)
    assert sorted((r.chain, r.seq) for r in both.collect()) == [("", 1), ("a", 1), ("a", 2), ("a", 3)]
    assert check(both) == [(1, True, None, None), (3, True, None, None)]
    assert check(one.limit(0)) == []
