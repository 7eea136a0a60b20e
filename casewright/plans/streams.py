"""Streaming queries, held against their batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.measures import micros
from casewright.plans.registry import query
from casewright.plans.standin import Tables
from casewright.storage import scratch
from casewright.streaming import bursts, windows


def _arriving(t: Tables, parts: int = 4) -> DataFrame:
    folder = scratch(t.spark, "arriving")
    t.events.repartition(parts, "user_id").write.parquet(folder)
    return bursts.event_stream(t.spark, folder, t.events)


@query("stream01_daily_counts", "select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2")
def _(t: Tables) -> DataFrame:
    return bursts.finished(bursts.daily_counts(_arriving(t)), "complete", "daily")


@query("stream02_once_each", "select event_id, user_id from events")
def _(t: Tables) -> DataFrame:
    folder = scratch(t.spark, "repeats")
    t.events.union(t.events).repartition(2).write.parquet(folder)
    stream = bursts.event_stream(t.spark, folder, t.events)
    return bursts.finished(bursts.without_repeats(stream, "event_id").select("event_id", "user_id"), "append", "once")


@query("wf02_queue_claims", "select event_id from events where event_type = 'signup'")
def _(t: Tables) -> DataFrame:
    return bursts.finished(_arriving(t).filter(F.col("event_type") == "signup").select("event_id"), "append", "claims")


@query("wf11_processing_job", "select user_id % 10 as case_id, count(*) as done from events group by 1")
def _(t: Tables) -> DataFrame:
    n = bursts.finished(_arriving(t).groupBy((F.col("user_id") % 10).alias("case_id")).agg(F.count("*").alias("done")), "complete", "jobs")
    return n


@query("stream03_sliding_counts", "select event_type, cast(cast(ts as date) - i::int as date) as day, count(*) as n from events cross join (select unnest(range(7)) as i) group by 1, 2")
def _(t: Tables) -> DataFrame:
    return bursts.finished(bursts.sliding_counts(_arriving(t)), "complete", "sliding")


@query(
    "stream04_sessions",
    "with x as (select user_id, event_id, us, case when us - lag(us) over w < 21600000000 then 0 else 1 end as new from ev window w as (partition by user_id order by us, event_id)), y as (select *, sum(new) over (partition by user_id order by us, event_id rows unbounded preceding) as session from x) "
    "select user_id, min(event_id) as first_id, count(*) as n, (max(us) - min(us)) / 1e6 as seconds from y group by user_id, session",
)
def _(t: Tables) -> DataFrame:
    return bursts.finished(bursts.sessions(_arriving(t), "user_id", "event_id", "6 hours"), "complete", "sessions")


@query(
    "stream05_day_bursts",
    "with d as (select user_id, cast(ts as date) as day, count(*) as n from events group by 1, 2), s as (select *, avg(n) over w as m, coalesce(nullif(stddev_pop(n) over w, 0), 1) as sd, count(*) over w as days from d window w as (partition by user_id)) select user_id, day, n from s where days >= 5 and (n - m) / sd >= 1.4321 and n >= 2",
)
def _(t: Tables) -> DataFrame:
    return bursts.latest(bursts.finished(bursts.day_bursts(_arriving(t), "user_id", 1.4321, 2), "update", "baseline"), "user_id")


_DAY, _WAIT = 86_400_000_000, 3 * 86_400_000_000
_CLOSING = (
    f"mk as (select max(us) filter (event_id % 10 <> 0) - {_WAIT} as first, max(us) - {_WAIT} as last from ev), "
    f"rw as (select event_id as \"row\", event_type as key, us, us // {_DAY} * {_DAY} as start, event_id % 10 = 0 and us // {_DAY} * {_DAY} + {_DAY} <= first as missed, last from ev cross join mk)"
)


def _closing(t: Tables) -> windows.WindowCounts:
    """Events in two lots, those of every tenth id after all others; the stream is started again for the second lot."""
    folder, checkpoint = scratch(t.spark, "lots"), scratch(t.spark, "lots-checkpoint")
    counts = windows.WindowCounts(t.spark, scratch(t.spark, "windows"), _DAY, _WAIT)
    for lot in ("event_id % 10 != 0", "event_id % 10 = 0"):
        t.events.filter(lot).coalesce(1).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(t.events.schema).parquet(folder)
        counts.run(stream.select(F.col("event_type").alias("key"), F.col("event_id").alias("row"), micros(F.col("ts")).alias("us")), checkpoint)
    return counts


@query("stream06_closed_windows", f"with {_CLOSING} select key, start, count(*) as n from rw where not missed and start + {_DAY} <= last group by 1, 2")
def _(t: Tables) -> DataFrame:
    return _closing(t).closed.read()


@query("stream06_late_rows", f"with {_CLOSING} select \"row\", key, us from rw where missed")
def _(t: Tables) -> DataFrame:
    return _closing(t).missed.read()
