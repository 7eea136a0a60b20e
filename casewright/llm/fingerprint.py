"""Document fingerprints: bottom-k sketches of shingle hashes, as column expressions.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles, read as unsigned by a flip
of the sign. Sketches of parts merge to the sketch of the whole; they estimate resemblance, containment and the number
of distinct shingles, and are exact up to k shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import SPACE, stored

K, WIDTH = 128, 5


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch (array<long>) of the hashes of ``width`` words in a row (lower-cased); all words as one shingle if there are fewer; empty without words."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<long>")).otherwise(sketch_of_words(F.split(trimmed, SPACE + "+"), k, width))


def sketch_of_words(words: Column, k: int = K, width: int = WIDTH) -> Column:
    # the word hashes are bound to a variable of their own, so that they are made once; places short of followers are cut off
    hashes = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    runs = F.transform(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)])))
    grams = F.slice(F.element_at(runs, 1), 1, F.greatest(F.size(words) - (width - 1), F.lit(1)))
    return F.slice(F.sort_array(F.array_distinct(grams)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of intersection / union; two empty sketches are alike (1), one empty is 0."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else (k - 1) over the share of the hash range below the k-th smallest."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that are in b, 0 to 1; 1 for an empty a."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """id and sketch of every row, in one pass without a shuffle. Null text counts as empty; other columns are not read."""
    return docs.select(F.col(id_col), sketch(F.col(text_col), k).alias("sketch"))


def followers(ids: DataFrame) -> DataFrame:
    """(id, half, before, before_half) of a table (id, half) of distinct ids: every id with the next smaller one, the smallest with the largest.

    Ids are dealt out by range; within a range the row before is the one, and between ranges (one row each) the
    last of the range before.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ranges")
    last = dealt.groupBy("part").agg(F.max(F.struct("id", "half")).alias("last"))
    order = Window.orderBy("part")  # a row for each range
    ends = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = last.select("part", F.coalesce(F.lag("last").over(order), ends).alias("edge"))
    within = dealt.withColumn("own", F.lag(F.struct("id", "half")).over(Window.partitionBy("part").orderBy("id")))
    before = F.coalesce("own", "edge")
    return within.join(F.broadcast(edges), "part").select("id", before["id"].alias("before"), before["half"].alias("before_half"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, text, next_start, next_sketch): each row with what it needs of the next document by id; null text is empty.

    ``next_start`` is the first half as many code points as the row's own text has (or all), ``next_sketch`` the whole next text's
    sketch. Rows with a null id have no next one (null). Of rows that repeat an id the one with the smallest text is the next of
    others. Rows that repeat an id and a text are rows of their own with the same next one. A single document is its own
    next one; an empty table gives no rows. Whole texts, however long, are shuffled by id once, for both sides of the join;
    what goes on to the row before is a start and a sketch. Other columns, whatever their names, are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = base.filter("id is not null")
    ids = stored(known.groupBy("id").agg(F.max(F.floor(F.length("text") / 2).cast("int")).alias("half"), F.count("*").alias("n")), "ids")
    nexts = known.join(followers(ids.select("id", "half")).hint("shuffle_merge"), "id")
    if ids.filter("n > 1").limit(1).count():
        nexts = nexts.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("text"))).filter("_n = 1")
    nexts = nexts.select(F.col("before").alias("id"), F.substring(F.col("text"), F.lit(1), F.col("before_half")).alias("next_start"), sketch(F.col("text"), k).alias("next_sketch"))
    none = base.filter("id is null").select("*", F.lit(None).cast("string").alias("next_start"), F.lit(None).cast("array<long>").alias("next_sketch"))
    return known.join(nexts.hint("shuffle_merge"), "id").unionByName(none)


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
