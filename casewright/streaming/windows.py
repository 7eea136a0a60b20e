"""Counts by window whose state ends: windows close, late rows go to a table of their own, and a batch that is run again changes nothing.

What is open is a table that holds the windows which rows can still reach, so its size follows the lateness that is allowed
and not how long the stream has run. A row that comes after its window has closed is not lost and not counted: it is kept
as late.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources.tables import ChangingTable


@dataclass(frozen=True)
class WindowCounts:
    """Counts of rows (key, row, us) by ``key`` (string) and window of ``width`` microseconds; ``row`` (long) is unique; ``late`` microseconds are waited for."""

    spark: SparkSession
    folder: str
    width: int
    late: int

    def _table(self, name: str, schema: str, *key: str) -> ChangingTable:
        return ChangingTable(self.spark, f"{self.folder}/{name}", schema, list(key))

    @property
    def open(self) -> ChangingTable:
        """Windows that rows can still reach, with their counts so far."""
        return self._table("open", "key string, start long, n long", "key", "start")

    @property
    def closed(self) -> ChangingTable:
        return self._table("closed", "key string, start long, n long", "key", "start")

    @property
    def missed(self) -> ChangingTable:
        """Rows that came when their window had closed."""
        return self._table("late", "row long, key string, us long", "row")

    @property
    def mark(self) -> ChangingTable:
        """The time before which windows are closed: the last row's time less what is waited for."""
        return self._table("mark", "one int, us long", "one")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Takes a batch. Each step is a version of the batch's number, and the mark, from which the others follow, comes last: a batch that was broken off is done again from where it stopped.

        Rows without a time are late.
        """
        name = f"batch {batch}"
        if self.mark._of(name) is not None:
            return
        old = self.mark.read().first()
        before = old["us"] if old else None
        start = F.floor(F.col("us") / self.width) * self.width
        told = rows.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("row").cast("long").alias("row"), F.col("us").cast("long").alias("us")).withColumn("start", start)
        shut = F.lit(False) if before is None else F.col("start") + self.width <= before
        shut = F.coalesce(shut, F.lit(True)) | F.col("us").isNull()
        self.missed.put(told.filter(shut), name)
        newest = told.agg(F.max("us").alias("us")).first()["us"]
        known = [x for x in (before, None if newest is None else newest - self.late) if x is not None]
        now = max(known) if known else None
        sums = self.open.read().unionByName(told.filter(~shut).groupBy("key", "start").agg(F.count("*").alias("n"))).groupBy("key", "start").agg(F.sum("n").alias("n"))
        ends = F.lit(False) if now is None else F.col("start") + self.width <= now
        self.closed.put(sums.filter(ends), name)
        self.open.put(sums.filter(~ends), name, kind="base")
        self.mark.put(self.spark.range(1).select(F.lit(1).alias("one"), F.lit(now).cast("long").alias("us")), name)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes all that is there of a stream of rows (key, row, us); started again with the checkpoint it goes on."""
        stream.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
