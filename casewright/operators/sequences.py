"""Rankings and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from casewright.functions import text as x


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Place in a total order over all rows, from 1, without one task for all: rows are sorted by range, and each range starts after those before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from casewright.storage import stored

    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = dealt.withColumn(out, F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(starts), "_part").withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start")


def first_of_each(df: DataFrame, keys: list[str], order: list, n: int, out: str) -> DataFrame:
    """The first ``n`` rows of each key in an order, with their place. Spark keeps ``n`` rows of a key in each task before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)


def gaps(events: DataFrame, key: str, at: str, row: str, least: int) -> DataFrame:
    """Events that come more than ``least`` after the one before of the same key, with ``before`` and ``gap``."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, row))
    return events.withColumn("before", before).withColumn("gap", F.col(at) - F.col("before")).filter(F.col("gap") > least)


def longest_gap(events: DataFrame, key: str, at: str, row: str, least: int) -> DataFrame:
    """(key, gap, since): the longest gap of each key, the earliest of equal ones."""
    best = gaps(events, key, at, row, least).groupBy(key).agg(F.min(F.struct(-F.col("gap"), "before")).alias("x"))
    return best.select(key, (-F.col("x.col1")).alias("gap"), F.col("x.before").alias("since"))


def busiest_sequence(events: DataFrame, case: str, key: str, at: str, row: str, least: int, n: int) -> DataFrame:
    """The first ``n`` events of the key with most events of each case (ties: smaller key), with place and step."""
    counts = events.groupBy(case, key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    busiest = counts.groupBy(case).agg(F.min(F.struct(-F.col("_n"), key))[key].alias(key))
    w = Window.partitionBy(case).orderBy(at, row)
    mine = events.join(busiest, [case, key])
    return mine.select(case, key, row, F.row_number().over(w).alias("n"), (F.col(at) - F.lag(at).over(w)).alias("step")).filter(F.col("n") <= n)


def islands(events: DataFrame, key: str, order: list[str], value: str) -> GroupedData:
    """Events grouped by key and ``island``: runs of one value."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    return events.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy(key, "island")


def hub_threshold(degrees: DataFrame, share: float = 0.25) -> DataFrame:
    """(threshold): the degree at place floor(n * share) of the descending order, 2 at least. Counts by degree are summed, not rows."""
    by = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    at = F.floor(F.col("total") * share)
    return by.withColumns({"above": above, "total": total}).filter((F.col("above") <= at) & (at < F.col("above") + F.col("n"))).select(F.greatest(F.lit(2).cast("long"), F.col("degree")).alias("threshold"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over all rows; a constant column is 0. The extremes are one row."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {}
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled[c] = F.when(hi - lo <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo)), 0.0).otherwise((F.col(c) - lo) / (hi - lo))
    return df.join(F.broadcast(ends)).withColumns(scaled).select(*df.columns)


def search(query: str, places: list[tuple[str, DataFrame, str, str, int]]) -> DataFrame:
    """(kind, id, label, relevance) of hits in each (kind, rows, id, label, most) of the list; at most so many of each."""
    out = None
    for kind, rows, key, label, most in places:
        hits = rows.filter(F.contains(F.lower(label), F.lit(query))).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"), x.match_score(F.col(label), query).alias("relevance"))
        hits = hits.orderBy(F.desc("relevance"), "label", "id").limit(most)
        out = hits if out is None else out.unionByName(hits)
    return out
