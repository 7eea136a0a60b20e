"""Answers about the subjects of cases as tables: profiles, neighbourhoods, timelines and places, each with what it cites and how sure it is.

Every function answers for all subjects that it is given, one or all of them, so that a question about one entity is a
filter before and not a plan of its own. Lists in the results (citations) have a fixed length; counts are over all rows.
A citation is text, ``kind:id``, and comes once, at its first place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators import graph as gr
from casewright.operators.sequences import first_of_each

#: Relations, events and findings that a profile cites, neighbours, dated events, places and claims of a place that an answer cites.
PROFILE_CITES = {"relationship": 8, "event": 8, "finding": 3}
NEIGHBOURS, DATED, PLACES, CLAIMS = 10, 15, 10, 3
MOST_HOPS = 5


def cite(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def share(n: Column | str, full: float) -> Column:
    """How much of ``full`` a count reaches, 1 at most."""
    return F.least(F.lit(1.0), (F.col(n) if isinstance(n, str) else n) / F.lit(float(full)))


def _ends(relations: DataFrame) -> DataFrame:
    """(id, relation, kind, other): a relation for each of its two ends, once where both are one entity."""
    r = relations.select(F.col("id").alias("relation"), "kind", F.explode(F.array_distinct(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))).alias("e"))
    return r.select("e.id", "relation", "kind", "e.other")


def profiles(entities: DataFrame, relations: DataFrame, events: DataFrame, claims: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per entity: id, name, entity_type, relations, kinds (each kind with its number, by kind), linked (other entities), events, last_event, claims, findings, confidence, citations.

    ``relations`` (id, kind, src, dst), ``events`` (id, entity, us), ``claims`` (id, subject), ``findings`` (id, entities).
    An entity without any row has zeros, an empty list of kinds and a citation of itself alone. Events without a time count
    and are cited last. Rows of entities that are not in ``entities`` (or null) are left out; an empty table gives no rows.
    """
    ends = _ends(relations)
    of_kind = ends.groupBy("id", "kind").agg(F.count("*").alias("n"))
    kinds = of_kind.groupBy("id").agg(F.sum("n").alias("relations"), F.sort_array(F.collect_list(F.concat_ws(" x ", "kind", F.col("n").cast("string")))).alias("kinds"))
    linked = ends.filter("other != id").groupBy("id").agg(F.countDistinct("other").alias("linked"))
    seen = events.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("events"), F.max("us").alias("last_event"))
    said = claims.groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("claims"))
    named = findings.select(F.col("id").alias("finding"), F.explode(F.array_distinct("entities")).alias("id"))
    found = named.groupBy("id").agg(F.count("*").alias("findings"))
    sections = [
        first_of_each(ends.select("id", F.col("relation").alias("key")).distinct(), ["id"], ["key"], PROFILE_CITES["relationship"], "at").select("id", F.lit(1).alias("section"), "at", cite("relationship", "key").alias("cited")),
        first_of_each(events.select(F.col("entity").alias("id"), F.col("id").alias("key"), "us"), ["id"], [F.asc_nulls_last("us"), "key"], PROFILE_CITES["event"], "at").select("id", F.lit(2).alias("section"), "at", cite("event", "key").alias("cited")),
        first_of_each(named, ["id"], ["finding"], PROFILE_CITES["finding"], "at").select("id", F.lit(3).alias("section"), "at", cite("finding", "finding").alias("cited")),
    ]
    cited = reduce(DataFrame.unionByName, sections).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section", "at", "cited"))), lambda c: c["cited"]).alias("cited"))
    out = reduce(lambda a, b: a.join(b, "id", "left"), [kinds, linked, seen, said, found, cited], entities.select("id", "name", "entity_type"))
    counts = ("relations", "linked", "events", "claims", "findings")
    out = out.na.fill(0, list(counts))
    sure = 0.4 + 0.15 * (share("relations", 3) + share("events", 3) + share("claims", 2) + share("findings", 2))
    none = F.array().cast("array<string>")
    return out.select("id", "name", "entity_type", *counts, "last_event", F.coalesce("kinds", none).alias("kinds"), sure.alias("confidence"), F.concat(F.array(cite("entity", "id")), F.coalesce("cited", none)).alias("citations"))


def neighbourhoods(entities: DataFrame, links: DataFrame, subjects: DataFrame, hops: int = 2) -> DataFrame:
    """(subject, id, name, entity_type, distance, confidence, cited): what is within ``hops`` (``MOST_HOPS`` at most) of each of ``subjects`` (id).

    ``cited`` is the place of the first ten by distance, name and id, null for others. Subjects without links have no rows.
    As large as the neighbourhoods are.
    """
    near = gr.within_hops(links.select("a", "b"), min(hops, MOST_HOPS), subjects.select("id")).filter("s != v")
    near = near.select(F.col("s").alias("subject"), F.col("v").alias("id"), F.col("d").alias("distance")).join(entities.select("id", "name", "entity_type"), "id", "left")
    size = near.groupBy("subject").agg((0.5 + 0.5 * share(F.count("*"), 10)).alias("confidence"))
    first = first_of_each(near.select("subject", "distance", "name", "id"), ["subject"], ["distance", "name", "id"], NEIGHBOURS, "cited").select("subject", "id", "cited")
    return near.join(size, "subject").join(first, ["subject", "id"], "left").select("subject", "id", "name", "entity_type", "distance", "confidence", "cited")


def timelines(events: DataFrame, scope: str) -> DataFrame:
    """The dated ones of ``events`` (``scope``, id, us, more columns) with total, dated, confidence and ``cited``: the place of the first fifteen of each scope by time and id, null for others.

    Events without a time count in ``total``; a scope that has no others has no rows. Other columns stay, but for those four names.
    """
    events = events.drop("total", "dated", "confidence", "cited")
    size = events.groupBy(scope).agg(F.count("*").alias("total"), F.count("us").alias("dated")).withColumn("confidence", 0.4 + 0.6 * F.col("dated") / F.col("total"))
    dated = events.filter(F.col("us").isNotNull())
    first = first_of_each(dated.select(scope, "us", "id"), [scope], ["us", "id"], DATED, "cited").select(scope, "id", "cited")
    return dated.join(size, scope).join(first, [scope, "id"], "left")


def _place_rows(claims: DataFrame, locations: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of places that claims give, with the location of the claim, and those of location rows, in one shape but for the scope."""
    spot = spots.select(F.col("id").alias("object_entity"), F.col("name").alias("spot"))
    at = locations.select(F.col("id").alias("location"), "lat", "lon")
    said = claims.join(spot, "object_entity", "left").join(at, "location", "left").withColumn("name", F.coalesce("spot", "object_value"))
    entity = F.when(F.col("spot").isNotNull(), F.col("object_entity"))
    one = said.withColumns({"source": F.lit(2), "entity_id": entity, "location_id": F.col("location"), "claim": F.col("id")})
    rows = locations.withColumns({"source": F.lit(1), "entity_id": F.lit(None).cast("long"), "location_id": F.col("id"), "claim": F.lit(None).cast("long")})
    return one, rows


def _merged(rows: DataFrame, scope: str) -> DataFrame:
    key = x.normalize_name(F.col("name"))
    rows = rows.filter(F.col("name").isNotNull() & (F.trim("name") != "")).withColumn("key", key)
    own = F.struct(F.col("location_id").isNull().alias("none"), "source", "location_id", "lat", "lon")
    merged = rows.groupBy(scope, "key").agg(
        F.min(F.struct("source", "name"))["name"].alias("name"), F.min("entity_id").alias("entity_id"), F.min(own).alias("own"), F.countDistinct("claim").alias("claims")
    )
    merged = merged.select(scope, "key", "name", "entity_id", F.col("own.location_id").alias("location_id"), F.col("own.lat").alias("lat"), F.col("own.lon").alias("lon"), "claims")
    mapped = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    size = merged.groupBy(scope).agg((0.5 + 0.5 * F.count_if(mapped) / F.count("*")).alias("confidence"))
    first = first_of_each(merged.select(scope, "key", "claims", "name"), [scope], [F.desc("claims"), F.lower("name"), "key"], PLACES, "cited").select(scope, "key", "cited")
    proof = rows.filter("claim is not null").select(scope, "key", "claim").distinct()
    proof = first_of_each(proof, [scope, "key"], ["claim"], CLAIMS, "at").groupBy(scope, "key").agg(F.sort_array(F.collect_list("claim")).alias("first_claims"))
    out = merged.join(size, scope).join(first, [scope, "key"], "left").join(proof, [scope, "key"], "left")
    head = F.when(F.col("location_id").isNotNull(), cite("location", "location_id")).when(F.col("entity_id").isNotNull(), cite("entity", "entity_id"))
    said = F.transform(F.coalesce("first_claims", F.array().cast("array<long>")), lambda c: cite("claim", c))
    return out.select(scope, "name", "entity_id", "location_id", "lat", "lon", "claims", "confidence", "cited", F.array_compact(F.concat(F.array(head), said)).alias("citations"))


def places_of_cases(claims: DataFrame, locations: DataFrame, spots: DataFrame) -> DataFrame:
    """(case_id, name, entity_id, location_id, lat, lon, claims, confidence, cited, citations): the places of each case from three sources, merged on the name without case and extra blanks.

    The sources are ``locations`` (id, case_id, name, lat, lon), entities that are places, ``spots`` (id, case_id, name), and
    ``claims`` (id, case_id, subject, object_entity, object_value, location), whose object is such an entity or a text. The
    name is written as in the first source that has it (location, claim, entity; then by letters); the location is the
    place's own row, else the smallest that a claim names. ``cited`` is the place of the first ten by claims and name.
    Rows without a name are left out. Confidence is half by the share of places with both coordinates.
    """
    one, rows = _place_rows(claims, locations, spots)
    shape = ["case_id", "name", "source", "entity_id", "location_id", "lat", "lon", "claim"]
    alone = spots.withColumns({"source": F.lit(3), "entity_id": F.col("id"), **{c: F.lit(None).cast(t) for c, t in (("location_id", "long"), ("lat", "double"), ("lon", "double"), ("claim", "long"))}})
    return _merged(one.select(*shape).unionByName(rows.select(*shape)).unionByName(alone.select(*shape)), "case_id")


def places_of_entities(claims: DataFrame, locations: DataFrame, spots: DataFrame, events: DataFrame) -> DataFrame:
    """As ``places_of_cases``, but of each subject: what its claims name, and the location rows that its claims or ``events`` (entity, location) are tied to."""
    one, rows = _place_rows(claims, locations, spots)
    tied = claims.select("subject", "location").unionByName(events.select(F.col("entity").alias("subject"), "location")).filter("subject is not null and location is not null").distinct()
    shape = ["subject", "name", "source", "entity_id", "location_id", "lat", "lon", "claim"]
    mine = tied.join(rows, F.col("location") == F.col("location_id")).select(*shape)
    return _merged(one.filter("subject is not null").select(*shape).unionByName(mine), "subject")


def proofs_of_entities(relations: DataFrame, evidence: DataFrame, events: DataFrame, claims: DataFrame) -> DataFrame:
    """(entity, evidence) once each: the records that relations (by their candidate), events and claims of an entity rest on."""
    ref = F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))
    by = relations.filter("candidate_id is not null").select(ref.alias("source_reference"), F.explode(F.array("src", "dst")).alias("entity"))
    by = by.join(evidence.select("source_reference", F.col("id").alias("evidence")), "source_reference").select("entity", "evidence")
    return by.unionByName(events.select("entity", "evidence")).unionByName(claims.select(F.col("subject").alias("entity"), "evidence")).filter("entity is not null and evidence is not null").distinct()


def cites_of_evidence(evidence: DataFrame, relations: DataFrame, events: DataFrame, claims: DataFrame, findings: DataFrame) -> DataFrame:
    """(evidence, kind, n, first): how many relations, events, claims and findings rest on each record, and the first six, six, four and three ids. Kinds that none rests on have no row."""
    ref = F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))
    by = relations.filter("candidate_id is not null").select(ref.alias("source_reference"), F.col("id").alias("key")).join(evidence.select("source_reference", F.col("id").alias("evidence")), "source_reference")
    rows = [
        by.select("evidence", F.lit("relationship").alias("kind"), "key", F.lit(6).alias("most")),
        events.select("evidence", F.lit("event").alias("kind"), F.col("id").alias("key"), F.lit(6).alias("most")),
        claims.select("evidence", F.lit("claim").alias("kind"), F.col("id").alias("key"), F.lit(4).alias("most")),
        findings.select(F.explode("evidence").alias("evidence"), F.lit("finding").alias("kind"), F.col("id").alias("key"), F.lit(3).alias("most")),
    ]
    every = reduce(DataFrame.unionByName, rows).join(evidence.select(F.col("id").alias("evidence")).distinct(), "evidence", "left_semi").distinct()
    n = every.groupBy("evidence", "kind").agg(F.count("*").alias("n"))
    first = first_of_each(every, ["evidence", "kind"], ["key"], 6, "at").filter("at <= most").groupBy("evidence", "kind").agg(F.sort_array(F.collect_list("key")).alias("first"))
    return n.join(first, ["evidence", "kind"])


def surely(rows: DataFrame, total: Column, out: str = "confidence") -> DataFrame:
    """``rows`` with an expression of their number (one row, broadcast)."""
    return rows.join(F.broadcast(rows.agg(total.alias(out))))


def numbered(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows in an order, with ``place``; only those reach one task."""
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
