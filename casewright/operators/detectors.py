"""Detectors of anomalies and contradictions, timeline and place findings, gaps, hypotheses, removal of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import config
from casewright.functions import measures as m
from casewright.operators import blocks
from casewright.operators.joins import band_pairs


def _meetings(events: DataFrame, who: str, where: str, at: str, row: str, window: float) -> DataFrame:
    """(u, v, place) of each meeting."""
    p = band_pairs(events, [where], at, window, row, [who]).filter(F.col(f"a_{who}") != F.col(f"b_{who}"))
    return p.select(F.least(f"a_{who}", f"b_{who}").alias("u"), F.greatest(f"a_{who}", f"b_{who}").alias("v"), F.col(where).alias("place"))


def _blocks(events: DataFrame, who: str, where: str, at: str, row: str, window: float, kept: Column | None = None) -> tuple[DataFrame, int] | None:
    """Rows for ``co_located`` and the number of blocks, if there are so many meetings that these are the shorter way (and ids and times are whole numbers); counted by place and time first."""
    kinds = dict(events.dtypes)
    if any(kinds[c] not in ("bigint", "int", "smallint", "tinyint") for c in (who, at, row)):
        return None
    met = events.groupBy(where, F.floor(F.col(at) / F.lit(window)).alias("_bucket")).agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    if met <= blocks.FEW_PAIRS:
        return None
    many, n = blocks.number_of_blocks(events, who)
    if not blocks.worth(met, many, n):
        return None
    long = lambda c: F.col(c).cast("long")
    return events.select(long(who).alias("who"), F.col(where).cast("string").alias("place"), long(at).alias("at"), long(row).alias("row"), (F.lit(True) if kept is None else kept).alias("kept")), many


def co_location(events: DataFrame, who: str, where: str, at: str, row: str, window: float, least: int, least_places: int) -> DataFrame:
    """(u, v, n, places): pairs seen at one place within ``window`` at least ``least`` times and at ``least_places`` places. Where meetings are many, they are counted by blocks of people."""
    dealt = _blocks(events, who, where, at, row, window)
    if dealt:
        return blocks.co_located(*dealt, int(window), least, least_places)
    n = _meetings(events, who, where, at, row, window).groupBy("u", "v").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"))
    return n.filter((F.col("n") >= least) & (F.col("places") >= least_places))


def co_location_again(events: DataFrame, who: str, where: str, at: str, row: str, window: float, least: int, least_places: int, excluded: Column) -> DataFrame:
    """(u, v, n, n_again): ``co_location`` of all events and of those that are not ``excluded``, null where a pair is not found; both counts of a pair are made in one task where meetings are many."""
    kept = ~F.coalesce(excluded, F.lit(False))
    dealt = _blocks(events, who, where, at, row, window, kept)
    if dealt:
        return blocks.co_located(*dealt, int(window), least, least_places, again=True).select("u", "v", "n", "n_again")
    first, second = (co_location(e, who, where, at, row, window, least, least_places).select("u", "v", "n") for e in (events, events.filter(kept)))
    return first.join(second.withColumnRenamed("n", "n_again"), ["u", "v"], "full_outer")


def co_location_top(events: DataFrame, who: str, where: str, at: str, row: str, window: float, top: int) -> DataFrame:
    """(u, v, n): the ``top`` pairs that were most often seen at one place within ``window``, ties by u and v."""
    dealt = _blocks(events, who, where, at, row, window)
    n = blocks.co_located(*dealt, int(window), 1, 1, top=top) if dealt else _meetings(events, who, where, at, row, window).groupBy("u", "v").agg(F.count("*").alias("n"))
    return n.select("u", "v", "n").orderBy(F.desc("n"), "u", "v").limit(top)


def movement_verdict(km: Column, minutes: Column, exact: Column, stated: Column, other_source: Column, same_record: Column) -> Column:
    """One verdict for two sightings; the branches are tried in this order. ``minutes`` is without the slack of stated times."""
    late = minutes + F.when(stated, config.STATED_SLACK_MIN).otherwise(0.0)
    speed = km / (late / 60)
    return (
        F.when(same_record, "none").when(~exact, "skip: time is not exact").when(km.isNull(), "skip: no coordinates").when(km < config.MIN_SEPARATION_KM, "consistent")
        .when(other_source & (late < config.MIN_INTERVAL_MIN), "skip: clocks may differ").when(late <= 0, "skip: same time")
        .when(speed > config.MAX_SPEED, "conflict").when(speed > config.UNUSUAL_SPEED, "unusual").otherwise("consistent")
    )


def steps(sightings: DataFrame, who: str, at: str, row: str, carry: list[str]) -> DataFrame:
    """Each sighting with the next one of the same person: next_<column>."""
    w = Window.partitionBy(who).orderBy(at, row)
    return sightings.withColumns({f"next_{c}": F.lead(c).over(w) for c in (at, row, *carry)}).filter(F.col(f"next_{row}").isNotNull())


def value_conflicts(claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n): subjects with two values or more."""
    return claims.groupBy(*keys).agg(F.countDistinct(value).alias("n")).filter("n >= 2")


def overlaps(events: DataFrame, case: str, at: str, who: str, row: str) -> DataFrame:
    """(case, at, a, b): events of a case at one time. If some of them have a person, only pairs of the same person; if none has, all pairs."""
    e = events.select(case, at, who, row)
    known = e.groupBy(case, at).agg(F.count(who).alias("_n"))
    x = e.select(case, at, F.col(who).alias("wa"), F.col(row).alias("a"))
    y = e.select(case, at, F.col(who).alias("wb"), F.col(row).alias("b"))
    same = x.filter("wa is not null").join(y.withColumnRenamed("wb", "wa"), [case, at, "wa"]).filter("a < b").select(case, at, "a", "b")
    none = known.filter("_n = 0").select(case, at)
    unnamed = x.join(none, [case, at], "left_semi").join(y, [case, at]).filter("a < b").select(case, at, "a", "b")
    return same.unionByName(unnamed)


def gap_findings(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, case_id, id): entities without a relation, relations without evidence."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("id"))
    lonely = entities.join(ends, "id", "left_anti").select(F.lit("relationship").alias("kind"), "case_id", "id")
    ref = F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))
    bare = relations.withColumn("source_reference", ref).join(evidence, "source_reference", "left_anti").select(F.lit("evidence").alias("kind"), "case_id", "id")
    return lonely.unionByName(bare)


def sole_provenance(relations: DataFrame, evidence: DataFrame, removed: Column) -> DataFrame:
    """(a, b, gone): pairs that some removed evidence (``removed`` of ``id``) proves, no other evidence does, and no relation of which lacks a candidate."""
    e = evidence.select("source_reference", F.coalesce(removed, F.lit(False)).alias("out"))
    ref = F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))
    r = relations.filter("src != dst").withColumn("source_reference", ref).join(e, "source_reference", "left")
    by = r.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(F.coalesce("out", F.lit(False))).alias("hit"), F.max(F.coalesce(~F.col("out"), F.lit(False))).alias("other"), F.max(F.col("candidate_id").isNull()).alias("open")
    )
    return by.select("a", "b", (F.col("hit") & ~F.col("other") & ~F.col("open")).alias("gone"))


def evidence_impact(evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, score): half for relations (4 is full), an eighth each for a document and for a second kind of relation."""
    ref = F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))
    r = relations.filter("candidate_id is not null").withColumn("source_reference", ref).groupBy("source_reference").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"))
    x = evidence.join(r, "source_reference", "left")
    score = 0.5 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 4) + F.when(F.col("document_id").isNotNull(), 0.125).otherwise(0.0) + F.when(F.col("kinds") > 1, 0.125).otherwise(0.0)
    return x.select("id", score.alias("score"))


def hypotheses(cases: DataFrame) -> DataFrame:
    """(case_id, score, band) of (case_id, evidence, documents, relations, entities, conflicts)."""
    provenance = F.when(F.col("evidence") > 0, F.col("documents") / F.col("evidence")).otherwise(0.0)
    consistency = 1 - F.least(F.lit(1.0), F.col("conflicts") / 2)
    score = m.hypothesis_score(F.col("evidence"), F.col("relations"), consistency, provenance, F.col("entities"))
    return cases.select("case_id", score.alias("score"), m.band(score).alias("band"))


def bad_transitions(moves: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Moves (from, to) that the table of transitions does not have; staying is always allowed."""
    ok = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return moves.filter((F.col("from") != F.col("to")) & ~F.array_contains(ok, F.concat_ws(">", "from", "to")))


def audit_breaks(log: DataFrame, chain: str, seq: str, body: str, own: str, prev: str) -> DataFrame:
    """(chain, first_break): the first entry of each chain whose hash is not that of its body and predecessor, or whose predecessor's hash differs."""
    w = Window.partitionBy(chain).orderBy(seq)
    before = F.coalesce(F.lag(own).over(w), F.lit(""))
    wrong = (F.col(prev) != before) | (F.col(own) != F.sha2(F.encode(F.concat(F.col(prev), F.col(body)), "utf-8"), 256))
    return log.withColumn("_wrong", wrong).filter("_wrong").groupBy(chain).agg(F.min(seq).alias("first_break"))
