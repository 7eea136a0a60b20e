"""Mixing sources to target weights by hash-threshold histograms, without a sort of the documents.

A document's hash is fixed, so the documents of a source under a threshold are a random share of it, and thresholds are
nested: a larger budget only adds documents. Words are summed by source and hash bucket; the bucket in which the
budget ends is refined by the next bits, and so on; then a filter on the threshold takes the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import stored, word_count
from casewright.operators.sequences import ranked

#: Three levels of 4096 buckets: 36 bits of hash.
BITS, LEVELS = 12, 3


#: Up to so many sources, counted first, a row for each is broadcast; beyond, the joins are shuffled ones.
FEW_SOURCES = 100_000


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size, weight) with ``target``: shares of ``share`` times all words by weight, at most ``most`` times a source.

    In rounds: what capped sources leave over is shared by weight among the others, and those that it lifts above their
    cap are capped, until none is. A round is a sum over the sources and a stored table; each caps one source at least.
    """
    cap = most * F.col("source_size")
    now = stored(sizes.withColumn("capped", F.lit(False)), "sources")
    while True:
        r = now.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("capped"), cap)).alias("taken"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weight"), F.count_if("capped").alias("n"),
        ).first()
        level = F.lit((share * (r["all"] or 0) - (r["taken"] or 0.0)) / r["weight"] if r["weight"] else 0.0)
        over = F.col("capped") | (level * F.col("weight") > cap)
        if not now.filter(over).count() > r["n"]:
            return now.select("source", "source_size", F.when(F.col("capped"), cap).otherwise(level * F.col("weight")).alias("target"))
        now = stored(now.withColumn("capped", over), "sources")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: id, size, source, source_size, target, copies, taken.

    Size is the number of words (null text: 0). Sources in order of code points, null last, have the weights of
    ``cycle`` in turn. A document is taken ``copies`` times in whole, at most ``most`` (rounded up) times. Rows that
    repeat an id, or have none, share a hash and are taken alike, so a source with many of them can miss its target by
    their size together. A source without words has target 0. No row is dropped: those that the mix leaves out have 0
    copies. Very long texts count whole; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    light = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.conv(F.left(F.md5(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")), F.lit(9)), 16, 10).cast("long").alias("h"),
        ),
        "sizes",
    )
    sizes = ranked(light.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.col("place") - 1) % len(cycle) + 1).cast("int"))
    # full copies of every document, and the words that are left to take by threshold
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = stored(targets(sizes.withColumn("weight", weight), share, most).withColumn("full", full).withColumn("left", F.col("target") - full * F.col("source_size")), "targets")
    few = goal.count() <= FEW_SOURCES
    keys = {"k1": F.coalesce("source", F.lit("")), "k2": F.col("source").isNull()}

    def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
        plan = plan.withColumns(keys).drop("source")
        return rows.withColumns(keys).join(F.broadcast(plan) if few else plan, ["k1", "k2"])

    # a prefix of hash bits in which the budget ends, and the words taken before it
    edge = goal.select("source", "left", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done"))
    for k in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - k)
        buckets = (
            with_plan(light, edge).filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
            .groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("done").alias("done"))
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # the first bucket that reaches the budget ends the threshold; it is refined at the next level
        edge = stored(
            buckets.withColumn("upto", F.col("done") + F.sum("words").over(run))
            .filter(F.col("upto") >= F.col("left")).groupBy("source")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("done"), "words", "left")).alias("x"))
            .select("source", "x.left", F.col("x.bucket").alias("prefix"), "x.done", "x.words"),
            f"edge{k}",
        )
    # the last bucket, mostly one document, is taken if that comes nearer to the budget
    last = edge.select(
        F.col("source").alias("s2"),
        (F.col("prefix") + F.when(2 * F.col("done") + F.col("words") <= 2 * F.col("left"), 1).otherwise(0)).alias("threshold"),
    )
    plan = stored(goal.join(last, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"), "plan")
    copies = F.col("full") + F.when((F.col("full") < most) & (F.col("h") < F.coalesce("threshold", F.lit(0))), 1).otherwise(0)
    return with_plan(light.withColumn("src", F.col("source")), plan.select("source", "source_size", "target", "full", "threshold")).withColumn("copies", copies.cast("int")).select(
        F.col("id").alias(id_col), "size", F.col("src").alias(source_col), "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )
