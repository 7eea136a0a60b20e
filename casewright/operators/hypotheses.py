"""Competing hypotheses of each case, each with its records and a score, and gaps in what is known (DA15, DA17).

A case has a bounded number of them: two readings of each of its first three contradictions, and two or three of its first
pair of persons that are linked only through others. Generated for all cases at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import config
from casewright.operators import joins as j
from casewright.operators.aggregates import degrees
from casewright.operators.graph import both_ways
from casewright.operators.sequences import first_of_each
from casewright.storage import stored

# Contradictions that are read, hypotheses of a case, indirect pairs that are looked at, difference of scores under which two readings can't be told apart.
MOST_CONTRADICTIONS, MOST_HYPOTHESES, MOST_PAIRS, SCORE_GAP = 3, 12, 8, 0.15
# The two readings of each kind of contradiction: title, statement, and whether the margin counts for or against it (null: half).
READINGS = {
    "movement": (("apparent conflict: assumptions", "is explained by the assumptions of the analysis, not by a record error", True), ("apparent conflict: record accuracy", "reflects a record that is inaccurate or misattributed", False)),
    "evidence": (("evidence conflict: attribution", "is explained by a misattribution, two people or a wrong link", True), ("evidence conflict: record accuracy", "reflects a claim that is inaccurate", False)),
    "ownership": (("mutual ownership: duplication", "reflects a record that was entered twice", None), ("mutual ownership: genuine", "may be genuine on both sides and needs the source documents", None)),
}
# Degrees from which a lack counts, gaps of a kind.
EVIDENCE_DEGREE, RELATION_DEGREE, IDENTITY_DEGREE, MOST_GAPS = 3, 2, 2, 5

_IDS = "array<bigint>"


def support(evidence: Column, documented: Column, relations: Column, consistency: Column, entities: Column) -> Column:
    """Score of a hypothesis by its numbers: records of evidence (4 is full), of which from a document, relations (3), entities (5), and how consistent it is."""
    w = config.HYPOTHESIS_WEIGHTS
    part = lambda n, full: F.least(F.lit(1.0), n / F.lit(float(full)))
    score = w[0] * part(evidence, 4) + w[1] * part(relations, 3) + w[2] * consistency + w[3] * documented / F.greatest(evidence, F.lit(1)) + w[4] * part(entities, 5)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def _scored(specs: DataFrame, documented: DataFrame) -> DataFrame:
    """``specs`` (case_id, place, title, statement, kind, entities, relations, evidence, consistency) with score and band; ``documented`` is (id) of evidence from a document."""
    held = specs.select("case_id", "place", F.explode("evidence").alias("id")).join(documented.select("id").distinct(), "id").groupBy("case_id", "place").agg(F.count("*").alias("_n"))
    n = lambda c: F.size(c)
    score = support(n("evidence"), F.coalesce("_n", F.lit(0)), n("relations"), F.col("consistency"), n("entities"))
    out = specs.join(held, ["case_id", "place"], "left").withColumn("score", score).drop("_n")
    return out.withColumn("band", F.when(F.col("score") >= 0.67, "HIGH").when(F.col("score") >= 0.34, "MEDIUM").otherwise("LOW"))


def _of_contradictions(contradictions: DataFrame) -> DataFrame:
    first = first_of_each(contradictions, ["case_id"], ["seq"], MOST_CONTRADICTIONS, "_k")
    forms = [
        F.when(
            F.col("kind") == kind,
            F.array(*[
                F.struct(
                    F.lit(title).alias("title"), F.concat(F.lit("the conflict "), "about", F.lit(f" {said}")).alias("statement"),
                    (F.lit(0.5) if way is None else F.round(F.col("margin"), 3) if way else F.round(1 - F.col("margin"), 3)).alias("consistency"),
                )
                for title, said, way in both
            ]),
        )
        for kind, both in READINGS.items()
    ]
    read = first.select("case_id", "_k", "entities", "relations", "evidence", F.posexplode(F.coalesce(*forms)).alias("_v", "h"))
    # relations stand behind a conflict about ownership only, evidence behind the others
    return read.select("case_id", (2 * F.col("_k") - 1 + F.col("_v")).cast("int").alias("place"), "h.title", "h.statement", F.lit("CONTRADICTION").alias("kind"), "entities", "relations", "evidence", "h.consistency")


def focal_pairs(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """(case_id, a, b, path): of each case the first pair of persons at distance 2 or 3 among its first MOST_PAIRS such pairs, with the smallest path.

    ``vertices`` is (id, case_id, person); links (a, b), a < b, are within a case. Pairs are in the order of length, persons in
    it, and node ids as text.
    """
    links = stored(links.select("a", "b"), "links")
    kind = vertices.select("id", F.col("person").cast("int").alias("p"), "case_id")
    node = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    far = j.indirect_pairs(links).join(kind.toDF("a", "x", "case_id"), "a").join(kind.select("id", "p").toDF("b", "y"), "b")
    far = far.withColumns({"s": F.least(node("a"), node("b")), "t": F.greatest(node("a"), node("b")), "persons": F.col("x") + F.col("y")})
    order = [F.asc("length"), F.desc("persons"), F.asc("s"), F.asc("t")]
    some = first_of_each(far, ["case_id"], order, MOST_PAIRS, "_k").filter("persons = 2")
    first = stored(some.groupBy("case_id").agg(F.min(F.struct("_k", "a", "b", "length")).alias("f")).select("case_id", "f.a", "f.b", "f.length"), "focal")
    u = stored(both_ways(links).select("src", "dst"), "both")
    walk = first.select("case_id", "a", "b", "length", F.array("a").alias("path"), F.col("a").alias("at"))
    found = None
    for k in range(1, 4):
        walk = walk.join(u, walk["at"] == u["src"]).filter(~F.array_contains("path", F.col("dst"))).select("case_id", "a", "b", "length", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        if k >= 2:
            done = walk.filter((F.col("length") == k) & (F.col("at") == F.col("b"))).select("case_id", "a", "b", "path")
            found = done if found is None else found.unionByName(done)
        walk = walk.filter((F.col("length") > k) & (F.col("at") != F.col("b")))
    return found.groupBy("case_id", "a", "b").agg(F.min("path").alias("path"))


def _of_pairs(focal: DataFrame, relations: DataFrame, proofs: DataFrame, documented: DataFrame) -> DataFrame:
    """Two readings of each focal pair, and a third where their scores are close; ``relations`` is (id, a, b), ``proofs`` (id of the relation, evidence)."""
    steps = focal.select("case_id", F.explode(F.transform(F.slice("path", 1, F.size("path") - 1), lambda v, i: F.struct(F.least(v, F.get("path", i + 1)).alias("a"), F.greatest(v, F.get("path", i + 1)).alias("b")))).alias("e")).select("case_id", "e.a", "e.b")
    on = stored(steps.join(relations, ["a", "b"]).select("case_id", "id"), "steps")
    ids = lambda c: F.sort_array(F.collect_set(c)).cast(_IDS)  # noqa: E731  (of one pair's path)
    held = on.groupBy("case_id").agg(ids("id").alias("relations")).join(on.join(proofs, "id").groupBy("case_id").agg(ids("evidence").alias("evidence")), "case_id", "left")
    base = focal.join(held, "case_id").withColumn("evidence", F.coalesce("evidence", F.array().cast(_IDS)))
    between = F.slice("path", 2, F.size("path") - 2)
    name = F.concat_ws(" - ", F.col("a").cast("string"), F.col("b").cast("string"))
    shown = F.array_join(F.transform("path", lambda v: v.cast("string")), " > ")
    none = F.array().cast(_IDS)
    spec = lambda k, title, statement, entities, links, evidence: F.struct(
        F.lit(2 * MOST_CONTRADICTIONS + k).alias("place"), F.concat(F.lit("connection "), name, F.lit(f": {title}")).alias("title"), statement.alias("statement"),
        entities.cast(_IDS).alias("entities"), links.alias("relations"), evidence.alias("evidence"),
    )
    two = F.array(
        spec(1, "recorded links", F.concat(F.lit("linked through "), shown, F.lit(", without a link of their own")), F.array_sort("path"), F.col("relations"), F.col("evidence")),
        spec(2, "mediated", F.concat(F.lit("runs through "), F.array_join(F.transform(between, lambda v: v.cast("string")), ", ")), F.slice(between, 1, 1), none, F.col("evidence")),
    )
    third = spec(3, "insufficient to distinguish", F.lit("the records do not tell the recorded links from the mediation"), F.array("a", "b"), F.col("relations"), none)
    flat = lambda df, h: df.select("case_id", F.explode(h).alias("h")).select("case_id", "h.*").withColumns({"kind": F.lit("STRUCTURE"), "consistency": F.lit(1.0)})
    known = stored(_scored(flat(base, two), documented), "readings")
    close = known.groupBy("case_id").agg((F.max("score") - F.min("score")).alias("gap")).filter(F.round("gap", 6) < SCORE_GAP)
    return known.unionByName(_scored(flat(base.join(close.select("case_id"), "case_id", "left_semi"), F.array(third)), documented))


def hypotheses(contradictions: DataFrame, links: DataFrame, vertices: DataFrame, relations: DataFrame, proofs: DataFrame, documented: DataFrame) -> DataFrame:
    """(case_id, rank, title, statement, kind, entities, relations, evidence, consistency, score, band): hypotheses of each case by falling score, then in the order in which they are made; MOST_HYPOTHESES at most.

    ``contradictions`` is (case_id, seq, kind, about, margin, entities, relations, evidence). A case without contradictions and
    without an indirect pair of persons has none.
    """
    made = _scored(_of_contradictions(contradictions), documented).unionByName(_of_pairs(focal_pairs(links, vertices), relations, proofs, documented))
    return first_of_each(made, ["case_id"], [F.desc("score"), F.asc("place")], MOST_HYPOTHESES, "rank").drop("place")


def gaps(entities: DataFrame, links: DataFrame, proved: DataFrame, identified: DataFrame, silences: DataFrame) -> DataFrame:
    """(case_id, kind, a, b, amount, place): four kinds of gaps of each case, MOST_GAPS of a kind at most.

    EVIDENCE: entities (id, case_id, person, name) of degree EVIDENCE_DEGREE or more that are not in ``proved`` (id). RELATIONSHIP: of
    the case's first MOST_GAPS indirect pairs those with both degrees RELATION_DEGREE or more, so there can be fewer. TIMELINE:
    the longest of ``silences`` (case_id, a, b, amount). IDENTITY: persons of degree IDENTITY_DEGREE or more that are not in
    ``identified`` (id). Within a kind they are in the order of name (evidence, identity), of the pair, or of length.
    """
    degree = stored(degrees(links.select("a", "b")), "degrees")
    known = stored(entities.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "known")
    none = F.lit(None).cast("long")
    row = lambda df, kind, order, a, b, amount: first_of_each(df, ["case_id"], order, MOST_GAPS, "place").select("case_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), amount.cast("long").alias("amount"), "place")
    by_name = [F.asc("name"), F.asc("id")]
    bare = row(known.filter(F.col("degree") >= EVIDENCE_DEGREE).join(proved.select("id").distinct(), "id", "left_anti"), "EVIDENCE_GAP", by_name, F.col("id"), none, F.col("degree"))
    nameless = row(known.filter((F.col("degree") >= IDENTITY_DEGREE) & F.col("person")).join(identified.select("id").distinct(), "id", "left_anti"), "IDENTITY_GAP", by_name, F.col("id"), none, F.col("degree"))
    silent = row(silences, "TIMELINE_GAP", [F.desc("amount"), F.asc("a"), F.asc("b")], F.col("a"), F.col("b"), F.col("amount"))
    kind = known.select("id", F.col("person").cast("int").alias("p"), "degree", "case_id")
    far = j.indirect_pairs(links.select("a", "b")).join(kind.toDF("a", "x", "da", "case_id"), "a").join(kind.select("id", "p", "degree").toDF("b", "y", "db"), "b")
    node = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    order = [F.asc("length"), F.desc(F.col("x") + F.col("y")), F.asc(F.least(node("a"), node("b"))), F.asc(F.greatest(node("a"), node("b")))]
    first = first_of_each(far, ["case_id"], order, MOST_GAPS, "place").filter((F.col("da") >= RELATION_DEGREE) & (F.col("db") >= RELATION_DEGREE))
    apart = first.select("case_id", F.lit("RELATIONSHIP_GAP").alias("kind"), "a", "b", F.col("length").cast("long").alias("amount"), "place")
    return bare.unionByName(apart).unionByName(silent).unionByName(nameless)
