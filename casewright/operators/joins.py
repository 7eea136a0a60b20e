"""Joins of evidence: by key with fallbacks, in bands of time or place, as of a time, by exclusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.measures import haversine_km
from casewright.storage import stored


def band_pairs(df: DataFrame, keys: list[str], at: str, width: float, row: str, carry: list[str]) -> DataFrame:
    """Pairs (a, b) of rows with equal ``keys`` and |a.at - b.at| <= ``width``, each pair once with the smaller ``row`` (unique) as a.

    Times are dealt to buckets of ``width``; a row meets its own bucket and the next only, so a hot key is cut by time and no
    key is paired with itself in whole. Columns: keys, a_/b_ of row, at and ``carry``.
    """
    cols = [row, at, *carry]
    bucket = F.floor(F.col(at) / F.lit(width)).cast("long")
    a = df.select(*keys, F.explode(F.array(bucket, bucket + 1)).alias("_at"), bucket.alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = df.select(*keys, bucket.alias("_at"), *[F.col(c).alias(f"b_{c}") for c in cols])
    same = (F.col("_a") == F.col("_at")) & (F.col(f"a_{row}") < F.col(f"b_{row}"))
    pairs = a.join(b, [*keys, "_at"]).filter((F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) <= width) & (same | (F.col("_a") < F.col("_at"))))
    swap = F.col(f"a_{row}") > F.col(f"b_{row}")
    sides = [F.when(swap, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x, y in (("a", "b"), ("b", "a")) for c in cols]
    return pairs.select(*keys, *sides)


def with_fallback(df: DataFrame, key: Column, first: DataFrame, other: Column, second: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the value of ``first`` (k, v) at ``key``, else of ``second`` at ``other``."""
    one = first.select(F.col("k").alias("_k1"), F.col("v").alias("_v1"))
    two = second.select(F.col("k").alias("_k2"), F.col("v").alias("_v2"))
    return df.join(one, key == F.col("_k1"), "left").join(two, other == F.col("_k2"), "left").withColumn(out, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def unique_keys(names: DataFrame, key: Column) -> DataFrame:
    """(k, v) of keys that one id only has."""
    return names.groupBy(key.alias("k")).agg(F.min("id").alias("v"), F.countDistinct("id").alias("n")).filter("n = 1").select("k", "v")


def preceding(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: float, value: str, row: str) -> DataFrame:
    """As-of join: each left row (``row`` unique) with the value of the last right row before it (at its time counts) within ``tolerance``; null without one.

    A left row looks into its own bucket of time and the one before, so a hot key is cut by time.
    """
    bucket = F.floor(F.col(at) / F.lit(tolerance)).cast("long")
    seek = left.select(F.col(row).alias("_row"), F.col(key).alias("_k"), F.explode(F.array(bucket - 1, bucket)).alias("_b"), F.col(at).alias("_l"))
    r = right.select(F.col(key).alias("_k"), bucket.alias("_b"), F.col(at).alias("_r"), F.col(value).alias("_v"))
    hit = seek.join(r, ["_k", "_b"]).filter((F.col("_r") <= F.col("_l")) & (F.col("_l") - F.col("_r") <= tolerance))
    best = hit.groupBy("_row").agg(F.max(F.struct("_r", "_v"))["_v"].alias(f"last_{value}"))
    return left.join(best, left[row] == best["_row"], "left").drop("_row")


#: Ids of more blocks than this are joined; a set of so many has 2 to that power subsets.
MOST_BLOCKS = 6


def sharing_after(blocks: DataFrame) -> DataFrame:
    """(a, n): how many larger ids share a block with each id, ids without one left out; ``blocks`` is (id, block), and an id may have several.

    Ids that share any of a's blocks are those that have one of them, less those that have two of them, and so on, so larger
    ids are counted by sets of blocks and no pair is made. Sets are dealt by ranges of set and id, so a common block is cut
    by ids. Only ids of more than MOST_BLOCKS blocks meet the others by a join.
    """
    k = stored(blocks.select("id", "block").dropna().distinct(), "blocked")
    sets = k.groupBy("id").agg(F.array_sort(F.collect_list("block")).alias("own"))
    empty = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("own", empty, lambda some, w: F.concat(some, F.transform(some, lambda s: F.concat(s, F.array(w)))))
    each = sets.filter(F.size("own") <= MOST_BLOCKS).select("id", F.explode(subsets).alias("of")).filter(F.size("of") > 0)
    parts = int(k.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(each.repartitionByRange(parts, "of", "id").withColumn("part", F.spark_partition_id()), "subsets")
    sizes = dealt.groupBy("of", "part").agg(F.count("*").alias("size"))
    later = sizes.select("of", "part", F.coalesce(F.sum("size").over(Window.partitionBy("of").orderBy("part").rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("later"))
    larger = F.row_number().over(Window.partitionBy("of", "part").orderBy(F.desc("id"))) - 1
    counted = dealt.withColumn("larger", larger).join(later, ["of", "part"])
    few = counted.select(F.col("id").alias("a"), (F.when(F.size("of") % 2 == 1, 1).otherwise(-1) * (F.col("larger") + F.col("later"))).alias("n"))
    long = k.join(sets.filter(F.size("own") > MOST_BLOCKS).select("id"), "id", "left_semi")
    met = long.toDF("x", "block").join(k.toDF("y", "block"), "block").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return few.unionByName(met.groupBy("a").agg(F.count("*").alias("n"))).groupBy("a").agg(F.sum("n").alias("n")).filter("n > 0")


def full_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status): added, removed, changed (a field differs, null-safe) or same."""
    x = a.select(F.col(key), F.struct(*fields).alias("_a"))
    y = b.select(F.col(key), F.struct(*fields).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return x.join(y, key, "full_outer").select(key, status.alias("status"))


def mutual(edges: DataFrame) -> DataFrame:
    """(src, dst), src < dst, of edges that exist in both directions."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.filter("src < dst").join(back, ["src", "dst"], "left_semi")


def two_hops(links: DataFrame) -> DataFrame:
    """(a, b), a < b, of nodes with a common neighbour and no link of their own; ``links`` is (a, b) with a < b."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.toDF("a", "mid").join(both.toDF("mid", "b"), "mid").filter("a < b").select("a", "b").distinct()
    return far.join(links, ["a", "b"], "left_anti")


def indirect_pairs(links: DataFrame) -> DataFrame:
    """(a, b, length), a < b, of nodes at distance 2 or 3; ``links`` is (a, b) with a < b.

    Of a pair at distance 3 the node before the last is at distance 2 from the first, so the third hop starts at pairs of ``two_hops``.
    """
    near = stored(two_hops(links), "hops")
    back = lambda df: df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = back(near).toDF("a", "mid").join(back(links).toDF("mid", "b"), "mid").filter("a < b").select("a", "b").distinct()
    far = far.join(near, ["a", "b"], "left_anti").join(links, ["a", "b"], "left_anti")
    return near.withColumn("length", F.lit(2)).unionAll(far.withColumn("length", F.lit(3)))


def within_km(places: DataFrame, row: str, km: float, radius: float) -> DataFrame:
    """(a, b, km) of places (``row``, lat, lon in degrees) at most ``km`` apart, a < b; places without a coordinate have none.

    The globe is dealt to belts of latitude as high as the distance, and a belt to cells of longitude that are at least as
    wide as the distance is at its end nearer to a pole, so towards the poles there are fewer of them, and one where the
    distance reaches over it. A place looks into its own cell and those beside it, round the date line, in its own belt and
    in the next; so each pair meets once.
    """
    angle = max(km / radius, 1e-9)
    high = math.degrees(angle)
    belt_of = lambda lat: F.floor((F.col(lat) + 90) / high).cast("long")

    def cells(belt: Column) -> Column:
        """Cells of a belt: as wide as the distance at the end that is nearest to a pole, of it or the belts beside it."""
        low, top = (belt - 1) * high - 90, (belt + 2) * high - 90
        edge = F.radians(F.greatest(F.abs(low), F.abs(top)))
        wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(edge))))
        return F.when((edge + angle >= math.pi / 2) | (angle >= math.pi / 2), 1).otherwise(F.greatest(F.lit(1), F.floor(360 / (wide * (1 + 1e-9))))).cast("long")

    turn = lambda lon: F.pmod(F.col(lon) + 180, F.lit(360.0))
    cell = lambda lon, n: F.least(F.floor(turn(lon) * n / 360), n - 1).cast("long")
    p = places.filter("lat is not null and lon is not null").select(F.col(row).alias("x"), "lat", "lon").withColumn("own", belt_of("lat"))
    a = p.select("x", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("belt")).withColumn("n", cells(F.col("belt")))
    here = cell("lon1", F.col("n"))
    a = a.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(here + k, F.col("n"))))))
    b = p.select(F.col("x").alias("y"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("own").alias("belt"), cell("lon", cells(F.col("own"))).alias("cell"))
    near = a.join(b, ["belt", "cell"]).filter((F.col("own") < F.col("belt")) | (F.col("x") < F.col("y")))
    first = F.col("x") < F.col("y")
    side = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v))
    far = haversine_km(side("lat1", "lat2"), side("lon1", "lon2"), side("lat2", "lat1"), side("lon2", "lon1"), radius)
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), far.alias("km")).filter(F.col("km") <= km)


def aligned(base: DataFrame, other: DataFrame) -> DataFrame:
    """(id, other_id, overlap, status) of persons of two runs by shared signatures (id, sig): one to one, larger overlaps first, then smaller ids.

    Each round keeps the pairs that are the best of both their ends, which is the greedy matching without its order; the loop
    ends when no pair is left. What is left of ``other`` is a split if it shares a signature with a taken person, else new.
    """
    left = stored(base.distinct().join(other.select(F.col("id").alias("other_id"), "sig").distinct(), "sig").groupBy("id", "other_id").agg(F.count("*").alias("overlap")), "overlaps")
    every, taken = left, None
    rank = F.struct(-F.col("overlap"), "id", "other_id")
    while left.limit(1).count():
        best = left.join(left.groupBy("id").agg(F.min(rank).alias("m")), "id").join(left.groupBy("other_id").agg(F.min(rank).alias("w")), "other_id")
        won = stored(best.filter((F.col("m") == rank) & (F.col("w") == rank)).select("id", "other_id", "overlap"), "won")
        taken = won if taken is None else taken.unionByName(won)
        left = stored(left.join(won.select("id"), "id", "left_anti").join(won.select("other_id"), "other_id", "left_anti"), "overlaps")
    if taken is None:
        taken = every.limit(0)
    matched = taken.withColumn("status", F.lit("matched"))
    rest = other.select(F.col("id").alias("other_id")).distinct().join(taken.select("other_id"), "other_id", "left_anti")
    shares = every.select("other_id").distinct().withColumn("s", F.lit(True))
    rest = rest.join(shares, "other_id", "left").select(F.lit(None).cast("long").alias("id"), "other_id", F.lit(0).cast("long").alias("overlap"), F.when(F.col("s"), "split").otherwise("new").alias("status"))
    return matched.unionByName(rest)
