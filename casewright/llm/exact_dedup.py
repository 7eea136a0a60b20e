"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

The first pass keeps a length and a prefix hash a document. Lengths are counted; of the rows whose length repeats the
prefix hashes are counted; only documents whose (length, prefix) repeats go on: they pass a filter of fixed size, their
full content is hashed, and the full hashes are grouped. Rows are never gathered by group, only aggregated, and the one
join by hash is an ordinary shuffled join, which adaptive execution splits where a group is hot. If every row's hash is
asked for, it is made in the first pass, so that texts are read and squeezed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import SPACE, key_filter, may_hold, stored


def squeeze(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    Texts are equal if they are equal without white space. Of equal texts the one with the most code points stays, then
    the smallest id (null ids last). ``digest`` is the SHA-256 of the normalised text; it is null for rows that no
    group survives for, unless ``digest_all``. Null text counts as empty, and all empty texts are equal. Of rows that
    repeat an id and a text only one is kept. Very long texts are one row as any other; an empty table gives none. Other
    columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("norm", squeeze(F.col("t")))
    digest = F.unhex(F.sha2("norm", 256))
    light = base.select(
        "id", F.length("t").alias("n_chars"), F.length("norm").alias("len"), F.xxhash64(F.left("norm", F.lit(prefix))).alias("head"),
        *([digest.alias("digest"), F.monotonically_increasing_id().alias("row")] if digest_all else ["norm"]),
    )
    if digest_all:
        sizes = light = stored(light, "sizes")
    else:
        sizes = stored(light.select("len", "head"), "sizes")
    # lengths that repeat; of their rows, prefixes that repeat; of theirs, full hashes
    lengths = stored(key_filter(sizes.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1"), F.col("len")), "lengths")
    heads = may_hold(sizes.select("len", "head"), F.col("len"), lengths, "goes_on").filter("goes_on").groupBy("len", "head").agg(F.count("*").alias("n")).filter("n > 1")
    marks = stored(key_filter(heads, F.xxhash64("len", "head")), "heads")
    full = may_hold(light.withColumn("group", F.xxhash64("len", "head")), F.col("group"), marks, "survives")
    if digest_all:
        full = full.select("id", "n_chars", "survives", "digest", "row")
    else:
        full = stored(full.select("id", "n_chars", "survives", F.when(F.col("survives"), digest).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))
    groups = full.filter("survives").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = stored(groups, "groups")  # read again, so that both sides of the join are plain exchanges and a hot group can be split
    # rows that stand alone get a key of their own, so that they do not meet in one task
    key = F.when(F.col("survives"), F.col("digest")).otherwise(F.encode(F.concat(F.lit("row "), F.col("row").cast("string")), "utf-8"))
    out = full.withColumn("key", key).join(groups.select(F.col("digest").alias("key"), "first", "n"), "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.c")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | (F.col("first.d") == F.col("row"))).alias("kept"),
        "digest",
    )
