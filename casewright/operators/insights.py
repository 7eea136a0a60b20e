"""Five short insights of every case: the best connected entity, the span of its events, the last mapped place, the place most seen, identifiers that belong to nobody."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.sequences import first_of_each

_DAY, _HOUR = 86_400_000_000, 3_600_000_000
LINKED = 6


def widest_gaps(events: DataFrame) -> DataFrame:
    """(case_id, events, first, last, gap, before, after): first and last time, and the widest gap between neighbours in time (the earliest of equal ones) with its two events; null with one event.

    Neighbours are sought in each day; days meet by their first and last event only, so a case of very many events is many tasks.
    """
    e = events.filter("us is not null and case_id is not null").select("case_id", "us", "id").withColumn("day", F.floor(F.col("us") / _DAY))
    order = Window.partitionBy("case_id", "day").orderBy("us", "id")
    last = F.lag(F.struct("us", "id")).over(order)
    step = lambda a, b: F.struct((a["us"] - b["us"]).alias("less"), a["us"].alias("us"), a["id"].alias("before"), b["id"].alias("after"))
    here = F.struct("us", "id")
    inside = e.withColumn("step", F.when(last.isNotNull(), step(last, here)))
    days = inside.groupBy("case_id", "day").agg(F.count("*").alias("n"), F.min(here).alias("lo"), F.max(here).alias("hi"), F.min("step").alias("inner"))
    before = F.lag("hi").over(Window.partitionBy("case_id").orderBy("day"))
    days = days.withColumn("outer", F.when(before.isNotNull(), step(before, F.col("lo"))))
    found = days.groupBy("case_id").agg(F.sum("n").alias("events"), F.min("lo.us").alias("first"), F.max("hi.us").alias("last"), F.min(F.least("inner", "outer")).alias("best"))
    return found.select("case_id", "events", "first", "last", (-F.col("best.less")).alias("gap"), F.col("best.before").alias("before"), F.col("best.after").alias("after"))


def insights(entities: DataFrame, relations: DataFrame, events: DataFrame, locations: DataFrame, identifiers: list[str]) -> DataFrame:
    """(case_id, category, subject, n, amount, confidence, linked): at most one row of each category for a case.

    ``link``: the entity with most link ends, the source of a relation counting twice, from 2 on. ``temporal``: events with a time
    (n, two or more), days that they span (amount, one at least), the event before the widest gap of three hours or more (subject). ``geo``:
    the place of the last event at a known one, n the places of the case. ``pattern``: the place with most events, from 2 on.
    ``anomaly``: n entities of the types ``identifiers`` without a relation. Equal ones: the smaller id; ``linked`` are up to six entities.
    """
    ends = relations.select(F.explode(F.array("src", "src", "dst")).alias("id"))
    degree = entities.select("id", "case_id").join(ends.groupBy("id").agg(F.count("*").alias("n")), "id")
    top = degree.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "id")).alias("t")).select("case_id", F.col("t.id").alias("subject"), (-F.col("t.less")).alias("n")).filter("n >= 2")
    shape = lambda category, subject, n, amount, sure, linked: [
        "case_id", F.lit(category).alias("category"), subject.cast("long").alias("subject"), n.cast("long").alias("n"), amount.cast("double").alias("amount"), sure.cast("int").alias("confidence"), linked.cast("array<long>").alias("linked"),
    ]
    col, lit, none = F.col, F.lit, F.lit(None)
    link = top.select(*shape("link", col("subject"), col("n"), none, F.least(lit(90), 50 + 8 * col("n")), F.array("subject")))
    dated = events.filter("us is not null and case_id is not null")
    seen = dated.filter("entity is not null").groupBy("case_id", "entity").agg(F.min(F.struct("us", "id")).alias("at"))
    six = first_of_each(seen, ["case_id"], ["at", "entity"], LINKED, "k").groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "entity"))), lambda e: e["entity"]).alias("linked"))
    span = widest_gaps(events).filter("events >= 2").join(six, "case_id", "left")
    days = F.greatest(lit(1.0), F.round((col("last") - col("first")) / _DAY))
    temporal = span.select(*shape("temporal", F.when(col("gap") >= 3 * _HOUR, col("before")), col("events"), days, lit(88), F.coalesce("linked", F.array().cast("array<long>"))))
    known = locations.groupBy("case_id").agg(F.count("*").alias("places"))
    at = dated.join(locations.select(col("id").alias("location")), "location", "left_semi")
    last = at.groupBy("case_id").agg(F.max(F.struct("us", "id", "location", "entity")).alias("t")).join(known, "case_id", "left")
    geo = last.select(*shape("geo", col("t.location"), F.coalesce("places", lit(0)), none, lit(84), F.array_compact(F.array(col("t.entity")))))
    visits = events.filter("location is not null and case_id is not null").groupBy("case_id", "location").agg(F.count("*").alias("n"))
    most = visits.groupBy("case_id").agg(F.min(F.struct((-col("n")).alias("less"), "location")).alias("t")).select("case_id", col("t.location").alias("subject"), (-col("t.less")).alias("n")).filter("n >= 2")
    pattern = most.select(*shape("pattern", col("subject"), col("n"), none, F.least(lit(88), 55 + 8 * col("n")), F.array()))
    orphan = entities.filter(col("entity_type").isin(*identifiers)).join(ends, "id", "left_anti").select("case_id", "id")
    count = orphan.groupBy("case_id").agg(F.count("*").alias("n"))
    first = first_of_each(orphan, ["case_id"], ["id"], LINKED, "k").groupBy("case_id").agg(F.sort_array(F.collect_list("id")).alias("linked"))
    anomaly = count.join(first, "case_id").select(*shape("anomaly", none, col("n"), none, lit(70), col("linked")))
    return reduce(DataFrame.unionByName, [link, temporal, geo, pattern, anomaly])
