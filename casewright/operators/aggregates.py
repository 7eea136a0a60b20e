"""Rollups of calls, payments and case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_rollup(calls: DataFrame, a: str, b: str, *measures: Column) -> DataFrame:
    """Measures by unordered pair (a < b); rows with equal or missing ends are left out."""
    ends = calls.filter(F.col(a) != F.col(b))
    return ends.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(*measures)


def shared_devices(calls: DataFrame, device: str, owner: str) -> DataFrame:
    """Devices with two owners or more: device, owners (sorted array)."""
    return calls.filter(F.col(device).isNotNull()).groupBy(device).agg(F.sort_array(F.collect_set(owner)).alias("owners")).filter(F.size("owners") > 1)


def merged_edges(observed: DataFrame) -> DataFrame:
    """Edges of observations (src, dst, type, weight, confidence, ts, source, seq): types and sources in the order of seq, sums, extremes. Loops are left out."""
    o = observed.filter("src != dst").withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    in_order = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", c))), lambda s: s[c]))
    return o.groupBy("a", "b").agg(
        in_order("type").alias("types"), F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count("*").alias("observations"), in_order("source").alias("sources"),
    )


def upserted(rows: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """One row a key: of each field the last value that is not null, "" or 0, else the first row's."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0"), F.struct(seq, c)))[c]
    return rows.groupBy(key).agg(*[F.coalesce(last(c), F.min(F.struct(seq, c))[c]).alias(c) for c in fields])


def bursts(days: DataFrame, z: float, least: int, least_days: int = 5, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Days (keys, day, n) whose count stands out: z-score over the days of the key with the population deviation (0 counts as 1); high from z + 1."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    scored = days.withColumns({"mean": F.avg("n").over(w), "sd": F.coalesce(F.nullif(F.stddev_pop("n").over(w), F.lit(0.0)), F.lit(1.0)), "days": F.count("*").over(w)})
    out = scored.withColumn("score", (F.col("n") - F.col("mean")) / F.col("sd")).filter((F.col("days") >= least_days) & (F.col("score") >= z) & (F.col("n") >= least))
    return out.select(*keys, "day", "n", "score", F.when(F.col("score") >= z + 1, "high").otherwise("medium").alias("severity"))


def burners(calls: DataFrame, max_contacts: int, max_days: int, least_calls: int) -> DataFrame:
    """Numbers (either leg of caller, callee, us) with few contacts in a short time: number, contacts, calls, days."""
    legs = calls.select(F.col("caller").alias("number"), F.col("callee").alias("other"), "us").union(calls.select(F.col("callee"), F.col("caller"), "us")).filter("number is not null and other is not null")
    n = legs.groupBy("number").agg(F.countDistinct("other").alias("contacts"), F.count("*").alias("calls"), F.floor((F.max("us") - F.min("us")) / 86_400_000_000).alias("days"))
    return n.filter((F.col("contacts") <= max_contacts) & (F.col("days") <= max_days) & (F.col("calls") >= least_calls))


def structuring(payments: DataFrame, threshold: float, band: float, least: int, keys: list[str]) -> DataFrame:
    """Groups with ``least`` payments or more of ``band`` of the threshold up to, not including, the threshold."""
    inside = payments.filter((F.col("gross") >= band * threshold) & (F.col("gross") < threshold))
    return inside.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("gross").alias("total")).filter(F.col("n") >= least)


def type_counts(vertices: DataFrame, edges: DataFrame, kind: str, types: str) -> DataFrame:
    """(what, name, n): vertices by kind, edges by each of their types."""
    v = vertices.groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n")
    e = edges.select(F.explode(types).alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "name", "n")
    return v.unionByName(e)


def degrees(links: DataFrame, *measures: Column) -> DataFrame:
    """(id, degree, ...) with parallel links counted; ``links`` is (a, b, ...)."""
    return links.select("*", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"), *measures)


def zero_filled(counts: DataFrame, label: str, labels: list, n: str) -> DataFrame:
    """(label, n) for each of ``labels`` in the list, 0 where ``counts`` has no row; other labels are left out."""
    every = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(label))
    return every.join(counts, label, "left").select(label, F.coalesce(n, F.lit(0).cast("long")).alias(n))


def weekly(events: DataFrame, ts: str, series: dict[str, Column]) -> DataFrame:
    """(week, a count for each of ``series``) from the first week of the events to the last, weeks from Monday; 0 in weeks without an event."""
    week = F.date_trunc("week", ts).cast("date").alias("week")
    n = events.groupBy(week).agg(*[F.count_if(test).alias(name) for name, test in series.items()])
    span = n.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))  # one row
    every = span.filter("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    return every.join(n, "week", "left").na.fill(0, list(series))
