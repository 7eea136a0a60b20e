"""Counts, sliding and session windows and day baselines of arriving events; run to the end of what is there, they equal the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.storage import scratch


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 8) -> DataFrame:
    """Events of the Parquet files of a folder as a stream, ``ts`` as a timestamp with zone."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "40 days") -> DataFrame:
    """(event_type, day, n) by event time; events later than ``late`` are left out."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy("event_type", day.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.to_date("w.start").alias("day"), "n")


def without_repeats(events: DataFrame, key: str, late: str = "40 days") -> DataFrame:
    """Each key once, however often its event arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sliding_counts(events: DataFrame, width: str = "7 days", step: str = "1 day", late: str = "40 days") -> DataFrame:
    """(event_type, day, n): events of the ``width`` that begins at ``day``, a window each ``step``."""
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.to_date("w.start").alias("day"), "n")


def sessions(events: DataFrame, key: str, row: str, gap: str, late: str = "40 days") -> DataFrame:
    """(key, first_id, n, seconds): runs of events of a key in which each comes less than ``gap`` after the one before."""
    us = F.unix_micros("ts")
    grouped = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
    n = grouped.agg(F.min(row).alias("first_id"), F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("seconds"))
    return n.select(key, "first_id", "n", "seconds")


def day_bursts(events: DataFrame, key: str, z: float, least: int, least_days: int = 5) -> DataFrame:
    """(key, day, n, seen) of the days that stand out of their key's days so far, as ``aggregates.bursts``, after each batch in which the key has events.

    The state of a key is its counts by day. ``seen`` is its number of events so far, so the rows with the largest ``seen``
    are the last word (``latest``); a row without a day says that all earlier ones are replaced.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        days, counts, seen = state.get if state.exists else ([], [], 0)
        have = dict(zip(days, counts, strict=True))
        for f in frames:
            for day, n in f["day"].value_counts().items():
                have[int(day)] = have.get(int(day), 0) + int(n)
                seen += int(n)
        state.update((list(have), list(have.values()), seen))
        n = np.array(list(have.values()))
        score = (n - n.mean()) / (n.std() or 1.0)
        out = [(d, c) for d, c, x in zip(have, n, score, strict=True) if len(n) >= least_days and x >= z and c >= least]
        yield pd.DataFrame({key: k[0], "day": pd.array([None, *[d for d, _ in out]], dtype="Int64"), "n": [0, *[int(c) for _, c in out]], "seen": seen})

    slim = events.select(key, F.unix_date(F.to_date("ts")).cast("long").alias("day"))
    return slim.groupBy(key).applyInPandasWithState(step, f"{key} long, day long, n long, seen long", "days array<long>, counts array<long>, seen long", "update", "NoTimeout")


def latest(found: DataFrame, key: str) -> DataFrame:
    """(key, day, n): the last word of ``day_bursts`` on each key."""
    last = found.groupBy(key).agg(F.max("seen").alias("seen"))
    return found.join(last, [key, "seen"], "left_semi").filter("day is not null").select(key, F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "n")


def finished(stream: DataFrame, mode: str, tag: str) -> DataFrame:
    """What a stream gives for all files that are there, as a stored table; the checkpoint makes a restart go on where it stopped."""
    spark = stream.sparkSession
    out = scratch(spark, tag)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, f"{tag}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)
