"""Hypotheses and gaps of every case (DA15, DA17, CQ07, CQ08, TK10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import hypotheses as h
from casewright.operators import sequences as s
from casewright.plans.joins import _INDIRECT
from casewright.plans.registry import query
from casewright.plans.standin import Tables

# Conflicts of the stand-in: pairs whose relations differ in confidence by a quarter or more, the largest difference first.
_CONFLICTS = (
    "pf as (select r.id, e.id as evidence from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id), "
    "cf as (select case_id, least(src, dst) as a, greatest(src, dst) as b, round(max(confidence) - min(confidence), 6)::double as spread, min(r.id) % 3 as sort, list_sort(list(distinct r.id)) as relations, list_sort(list(distinct pf.evidence) filter (pf.evidence is not null)) as evidence from relation r left join pf on pf.id = r.id where src <> dst group by 1, 2, 3 having round(max(confidence) - min(confidence), 6) >= .25), "
    "cr as (select *, row_number() over (partition by case_id order by spread desc, a, b) as seq from cf)"
)
_CASE_PAIRS = (
    ", hp as (select f.*, x.case_id, (x.entity_type = 'PERSON')::int + (y.entity_type = 'PERSON')::int as persons, least('e' || a, 'e' || b) as s, greatest('e' || a, 'e' || b) as t from f join entity x on x.id = a join entity y on y.id = b), "
    "hk as (select *, row_number() over (partition by case_id order by length, persons desc, s, t) as k from hp)"
)
_READ = " union all ".join(
    f"select case_id, 2 * seq - 1 + {v} as place, '{title}' as title, 'the conflict ' || a || '/' || b || ' {said}' as statement, 'CONTRADICTION' as kind, [a, b] as entities, case when kind <> 'ownership' then []::bigint[] else relations end as relations, coalesce(evidence, []::bigint[]) as evidence, "
    + ("0.5::double" if way is None else "round(spread, 3)" if way else "round(1 - spread, 3)")
    + f" as consistency from (select *, case sort when 0 then 'movement' when 1 then 'ownership' else 'evidence' end as kind from cr where seq <= 3) where kind = '{kind}'"
    for kind, both in h.READINGS.items()
    for v, (title, said, way) in enumerate(both)
)
_PATHS = (
    ", fo as (select case_id, arg_min(a, k) as a, arg_min(b, k) as b, arg_min(length, k) as length from hk where k <= 8 and persons = 2 group by 1), "
    "wk as (select fo.case_id, fo.a, fo.b, min([fo.a, x.b, fo.b]) as path from fo join u x on x.a = fo.a join u y on y.a = x.b and y.b = fo.b where length = 2 group by 1, 2, 3 "
    "union all select fo.case_id, fo.a, fo.b, min([fo.a, x.b, y.b, fo.b]) from fo join u x on x.a = fo.a join u y on y.a = x.b join u z on z.a = y.b and z.b = fo.b where length = 3 and y.b <> fo.a and x.b <> fo.b group by 1, 2, 3), "
    "st as (select case_id, unnest(range(1, len(path))) as i, path from wk), sr as (select st.case_id, r.id, pf.evidence from st join relation r on least(r.src, r.dst) = least(path[i], path[i + 1]) and greatest(r.src, r.dst) = greatest(path[i], path[i + 1]) left join pf on pf.id = r.id), "
    "ag as (select case_id, list_sort(list(distinct id)) as relations, coalesce(list_sort(list(distinct evidence) filter (evidence is not null)), []::bigint[]) as evidence from sr group by 1), "
    "bs as (select wk.*, ag.relations, ag.evidence from wk join ag using (case_id))"
)
_STRUCTURE = (
    "select case_id, 7 as place, 'connection ' || a || ' - ' || b || ': recorded links' as title, 'linked through ' || array_to_string(path, ' > ') || ', without a link of their own' as statement, 'STRUCTURE' as kind, list_sort(path) as entities, relations, evidence, 1.0::double as consistency from bs "
    "union all select case_id, 8, 'connection ' || a || ' - ' || b || ': mediated', 'runs through ' || array_to_string(path[2:-2], ', '), 'STRUCTURE', path[2:2], []::bigint[], evidence, 1.0 from bs"
)
_SCORE = (
    "round(greatest(0.0, least(1.0, .30 * least(1.0, len(evidence) / 4.0) + .20 * least(1.0, len(relations) / 3.0) + .20 * consistency + .15 * (select count(*) from evidence v where list_contains({0}.evidence, v.id) and v.document_id is not null) / greatest(len(evidence), 1) + .15 * least(1.0, len(entities) / 5.0)))::double, 3) as score"
)
_HYPOTHESES = (
    _INDIRECT
    + f", {_CONFLICTS}{_CASE_PAIRS}{_PATHS}, sp as ({_READ} union all {_STRUCTURE}), s1 as (select *, {_SCORE.format('sp')} from sp), "
    "cl as (select case_id from s1 where place in (7, 8) group by 1 having round(max(score) - min(score), 6) < .15), "
    "th as (select bs.case_id, 9 as place, 'connection ' || a || ' - ' || b || ': insufficient to distinguish' as title, 'the records do not tell the recorded links from the mediation' as statement, 'STRUCTURE' as kind, [a, b] as entities, relations, []::bigint[] as evidence, 1.0::double as consistency from bs join cl using (case_id)), "
    f"s2 as (select * from s1 union all select *, {_SCORE.format('th')} from th), hy as (select *, case when score >= .67 then 'HIGH' when score >= .34 then 'MEDIUM' else 'LOW' end as band, row_number() over (partition by case_id order by score desc, place) as rank from s2)"
)


def _proofs(t: Tables) -> DataFrame:
    ref = F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))
    return t.relation.withColumn("source_reference", ref).join(t.evidence.select("source_reference", F.col("id").alias("evidence")), "source_reference").select("id", "evidence")


def _hypotheses(t: Tables) -> DataFrame:
    proofs = _proofs(t)
    r = t.relation.filter("src != dst").select("case_id", "id", "confidence", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    ids = lambda c: F.sort_array(F.collect_set(c))  # noqa: E731  (of one pair)
    spread = F.round(F.max("confidence") - F.min("confidence"), 6).alias("spread")
    cf = r.join(proofs, "id", "left").groupBy("case_id", "a", "b").agg(spread, ids("id").alias("relations"), ids("evidence").alias("evidence")).filter("spread >= 0.25")
    first = s.first_of_each(cf, ["case_id"], [F.desc("spread"), F.asc("a"), F.asc("b")], h.MOST_CONTRADICTIONS, "seq").withColumn("sort", F.get("relations", 0) % 3)
    kind = F.when(F.col("sort") == 0, "movement").when(F.col("sort") == 1, "ownership").otherwise("evidence")
    told = first.select(
        "case_id", "seq", kind.alias("kind"), F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("about"), F.col("spread").alias("margin"), F.array("a", "b").alias("entities"),
        F.when(kind == "ownership", F.col("relations")).otherwise(F.array().cast("array<bigint>")).alias("relations"), "evidence",
    )
    vertices = t.entity.select("id", "case_id", (F.col("entity_type") == "PERSON").alias("person"))
    return h.hypotheses(told, t.pair, vertices, r.select("id", "a", "b"), proofs, t.evidence.filter("document_id is not null").select("id"))


@query("da17_hypotheses", _HYPOTHESES + " select case_id, rank, title, statement, kind, entities, relations, evidence, consistency, score, band from hy where rank <= 12")
def _(t: Tables) -> DataFrame:
    """All hypotheses of all cases with their statements, records and scores."""
    return _hypotheses(t)


@query("cq08_hypotheses_by_score", _HYPOTHESES + ", tp as (select case_id, max(score) as confidence from hy group by 1) select case_id, rank, title, score, confidence from hy join tp using (case_id) where rank <= 12")
def _(t: Tables) -> DataFrame:
    """A case's hypotheses by score; the answer is as sure as the best of them."""
    from pyspark.sql import Window

    return _hypotheses(t).withColumn("confidence", F.max("score").over(Window.partitionBy("case_id"))).select("case_id", "rank", "title", "score", "confidence")


_SILENCES = "ev2 as (select user_id % 5 as case_id, event_id, us, lag(event_id) over (partition by user_id % 5, user_id order by us, event_id) as before, us - lag(us) over (partition by user_id % 5, user_id order by us, event_id) as gap from ev), si as (select case_id, before as a, event_id as b, gap // 60000000 as amount from ev2 where gap > 43200000000)"
_GAPS = (
    _INDIRECT
    + f"{_CASE_PAIRS}, {_SILENCES}, dg as (select a as id, count(*) as degree from u group by 1), en as (select e.*, coalesce(degree, 0) as degree from entity e left join dg using (id)), "
    "pv as (select distinct src as id from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id), "
    "gp as (select case_id, 'EVIDENCE_GAP' as kind, id as a, null::bigint as b, degree as amount, row_number() over (partition by case_id order by name, id) as place from en where degree >= 3 and id not in (select id from pv) "
    "union all select case_id, 'RELATIONSHIP_GAP', hk.a, hk.b, length, k from hk join dg x on x.id = hk.a join dg y on y.id = hk.b where k <= 5 and x.degree >= 2 and y.degree >= 2 "
    "union all select case_id, 'TIMELINE_GAP', a, b, amount, row_number() over (partition by case_id order by amount desc, a, b) from si "
    "union all select case_id, 'IDENTITY_GAP', id, null, degree, row_number() over (partition by case_id order by name, id) from en where entity_type = 'PERSON' and degree >= 2 and id % 4 <> 0)"
)


def _gaps(t: Tables) -> DataFrame:
    entities = t.entity.select("id", "case_id", "name", (F.col("entity_type") == "PERSON").alias("person"))
    proved = t.relation.join(_proofs(t).select("id").distinct(), "id", "left_semi").select(F.col("src").alias("id"))
    ev = t.ev.select((F.col("user_id") % 5).alias("case"), "user_id", "event_id", "us")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    silent = ev.select(F.col("case").alias("case_id"), F.lag("event_id").over(w).alias("a"), F.col("event_id").alias("b"), (F.col("us") - F.lag("us").over(w)).alias("gap")).filter("gap > 43200000000")
    return h.gaps(entities, t.pair, proved, t.entity.filter("id % 4 = 0").select("id"), silent.select("case_id", "a", "b", F.expr("gap div 60000000").alias("amount")))


@query("da15_gap_kinds", _GAPS + " select case_id, kind, a, b, amount, place from gp where place <= 5")
def _(t: Tables) -> DataFrame:
    return _gaps(t)


@query("cq07_gaps_by_case", _GAPS + " select case_id, kind, count(*) as n from gp where place <= 5 group by 1, 2")
def _(t: Tables) -> DataFrame:
    return _gaps(t).groupBy("case_id", "kind").agg(F.count("*").alias("n"))
