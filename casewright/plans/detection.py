"""Domain analytics (DA), named questions (CQ) and workflow (WF) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import measures as m
from casewright.functions import text as x
from casewright.operators import aggregates as g
from casewright.operators import detectors as d
from casewright.operators import filters as f
from casewright.operators import graph as gr
from casewright.operators import joins as j
from casewright.operators import sequences as s
from casewright.plans.registry import query
from casewright.plans.standin import Tables

_MIN = 60_000_000
_KM = "2 * {r} * asin(sqrt((pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"


@query("da01_repeated_co_location", "select least(a.user_id, b.user_id) as u, greatest(a.user_id, b.user_id) as v, count(*) as n, count(distinct event_type) as places from ev a join ev b using (event_type) where a.event_id < b.event_id and a.user_id <> b.user_id and abs(a.us - b.us) <= 300000000 group by 1, 2 having count(*) >= 2 and count(distinct event_type) >= 2")
def _(t: Tables) -> DataFrame:
    return d.co_location(t.ev, "user_id", "event_type", "us", "event_id", 5 * _MIN, 2, 2)


@query("da02_custody_conflicts", "with c as (select user_id, min(us) as since, case when user_id % 5 <> 0 then min(us) + 172800000000 end as until from ev where event_type = 'error' group by 1) select e.user_id, count(*) as n from ev e join c on e.user_id = c.user_id and e.us between since and coalesce(until, 9000000000000000) group by 1 having count(*) >= 3")
def _(t: Tables) -> DataFrame:
    held = t.ev.filter("event_type = 'error'").groupBy("user_id").agg(F.min("us").alias("since"))
    until = F.coalesce(F.when(F.col("user_id") % 5 != 0, F.col("since") + 172_800_000_000), F.lit(9_000_000_000_000_000))
    return t.ev.join(held, "user_id").filter(F.col("us").between(F.col("since"), until)).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 3")


_SIGHT = "sg as (select e.event_id, e.user_id, e.us, e.event_type, e.k % 4 as precision, p.lat, p.lon from ev e join place p on e.k % 25 = p.id), st as (select *, lead(event_id) over w as next_event_id, lead(us) over w as us2, lead(event_type) over w as type2, lead(precision) over w as precision2, lead(lat) over w as lat2, lead(lon) over w as lon2 from sg window w as (partition by user_id order by us, event_id))"
_VERDICT = f"{_SIGHT}, vd as (select *, {_KM.format(r=6371.0)} as km, abs(us2 - us) / 6e7 + case when precision = 1 or precision2 = 1 then 15.0 else 0 end as late from st where next_event_id is not null), vr as (select event_id, event_type, type2, km, late, case when precision = 3 or precision2 = 3 then 'skip: time is not exact' when km is null then 'skip: no coordinates' when km < 1.5 then 'consistent' when event_type <> type2 and late < 2 then 'skip: clocks may differ' when late <= 0 then 'skip: same time' when km / (late / 60) > 120 then 'conflict' when km / (late / 60) > 80 then 'unusual' else 'consistent' end as verdict from vd)"


def _verdicts(t: Tables) -> DataFrame:
    sg = t.ev.join(t.place.select("id", "lat", "lon"), F.col("k") % 25 == F.col("id")).withColumn("precision", F.col("k") % 4)
    st = d.steps(sg, "user_id", "us", "event_id", ["event_type", "precision", "lat", "lon"])
    c = F.col
    km = m.haversine_km(c("lat"), c("lon"), c("next_lat"), c("next_lon"))
    exact = (c("precision") != 3) & (c("next_precision") != 3)
    stated = (c("precision") == 1) | (c("next_precision") == 1)
    minutes = m.minutes_between(c("us"), c("next_us"))
    verdict = d.movement_verdict(km, minutes, exact, stated, c("event_type") != c("next_event_type"), F.lit(False))
    late = minutes + F.when(stated, 15.0).otherwise(0.0)
    return st.select("event_id", "event_type", "next_event_type", km.alias("km"), late.alias("late"), verdict.alias("verdict"))


@query("da03_movement_verdicts", f"with {_VERDICT} select event_id, verdict from vr")
def _(t: Tables) -> DataFrame:
    return _verdicts(t).select("event_id", "verdict")


@query("da04_timeline_conflicts", f"with {_VERDICT} select event_id, case when km / (late / 60) > 240 then 'high' else 'medium' end as severity from vr where verdict = 'conflict' and event_type = type2")
def _(t: Tables) -> DataFrame:
    v = _verdicts(t).filter("verdict = 'conflict' and event_type = next_event_type")
    return v.select("event_id", F.when(F.col("km") / (F.col("late") / 60) > 240, "high").otherwise("medium").alias("severity"))


@query("da05_location_inconsistencies", f"with {_VERDICT} select event_id, verdict from vr where verdict in ('conflict', 'unusual') and event_type <> type2")
def _(t: Tables) -> DataFrame:
    return _verdicts(t).filter("verdict in ('conflict', 'unusual') and event_type != next_event_type").select("event_id", "verdict")


@query("da07_identity_conflicts", "select user_id, event_type, count(distinct k) as n from ev group by 1, 2 having count(distinct k) >= 2")
def _(t: Tables) -> DataFrame:
    return d.value_conflicts(t.ev, ["user_id", "event_type"], "k")


@query("da08_claim_families", "select 'sighting' as family, user_id as subject, event_id as id from ev where k is not null union all select 'device', caller, call_id from call where callee is not null union all select 'attribute', id, id from person where prior_cases is not null")
def _(t: Tables) -> DataFrame:
    a = t.ev.filter("k is not null").select(F.lit("sighting").alias("family"), F.col("user_id").alias("subject"), F.col("event_id").alias("id"))
    b = t.call.filter("callee is not null").select(F.lit("device").alias("family"), F.col("caller").alias("subject"), F.col("call_id").alias("id"))
    return a.unionByName(b).unionByName(t.person.filter("prior_cases is not null").select(F.lit("attribute").alias("family"), F.col("id").alias("subject"), "id"))


@query("da09_skip_ledger", f"with {_VERDICT} select verdict, count(*) as n from vr where starts_with(verdict, 'skip') group by 1")
def _(t: Tables) -> DataFrame:
    return _verdicts(t).filter(F.col("verdict").startswith("skip")).groupBy("verdict").agg(F.count("*").alias("n"))


_R12 = f"with sg as (select e.user_id, e.event_id, e.us, p.id as place, p.lat, p.lon from ev e join place p on e.k % 25 = p.id), pr as (select a.user_id, a.event_id as i, b.event_id as j, abs(a.us - b.us) as dus, a.place as pa, b.place as pb, a.lat, a.lon, b.lat as lat2, b.lon as lon2, row_number() over (partition by a.user_id order by a.event_id, b.event_id) as n from sg a join sg b on a.user_id = b.user_id and a.event_id < b.event_id and abs(a.us - b.us) <= 7200000000) select i, j, case when dus = 0 then 'same time' else 'travel time' end as rule from pr where n <= 10 and pa <> pb and lon is not null and lon2 is not null and {_KM.format(r=6371.0088)} / 100 * 60 > dus / 6e7"


@query("da10_travel_time", _R12)
def _(t: Tables) -> DataFrame:
    sg = t.ev.join(t.place.select(F.col("id").alias("place"), "lat", "lon"), F.col("k") % 25 == F.col("place"))
    p = j.band_pairs(sg, ["user_id"], "us", 120 * _MIN, "event_id", ["place", "lat", "lon"])
    p = s.first_of_each(p, ["user_id"], ["a_event_id", "b_event_id"], 10, "n").filter("a_place != b_place and a_lon is not null and b_lon is not null")
    c = F.col
    km = m.haversine_km(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon"), m.config.RADIUS_CASE)
    minutes = m.minutes_between(c("a_us"), c("b_us"))
    return p.filter(km / m.config.CASE_SPEED * 60 > minutes).select(c("a_event_id").alias("i"), c("b_event_id").alias("j"), F.when(minutes == 0, "same time").otherwise("travel time").alias("rule"))


@query("da11_claim_contradictions", "select a.event_id as a, b.event_id as b, case when abs(a.us - b.us) <= 300000000 then 'HIGH' else 'MEDIUM' end as severity, 1 - abs(a.us - b.us) / 6e7 / 15 as margin from ev a join ev b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and abs(a.us - b.us) <= 900000000 and a.k <> b.k")
def _(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["user_id", "event_type"], "us", 15 * _MIN, "event_id", ["k"]).filter("a_k != b_k")
    minutes = m.minutes_between(F.col("a_us"), F.col("b_us"))
    return p.select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), F.when(minutes <= 5, "HIGH").otherwise("MEDIUM").alias("severity"), (1 - minutes / 15).alias("margin"))


@query("da12_event_overlap", "with h as (select case_id, us // 3600000000 as hour, case when user_id % 3 > 0 then user_id end as who, event_id from ev), n as (select case_id, hour, count(who) as known from h group by 1, 2) select case_id, hour, a.event_id as a, b.event_id as b from h a join h b using (case_id, hour) join n using (case_id, hour) where a.event_id < b.event_id and (a.who = b.who or known = 0)")
def _(t: Tables) -> DataFrame:
    h = t.ev.select("case_id", F.floor(F.col("us") / 3_600_000_000).alias("hour"), F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("who"), "event_id")
    return d.overlaps(h, "case_id", "hour", "who", "event_id")


@query("da13_timeline_findings", "with p as (select 'proximity' as kind, 1 as o, a.event_id as id from ev a join ev b on a.user_id = b.user_id and a.event_id < b.event_id and abs(a.us - b.us) <= 1800000000 and a.us <> b.us), q as (select 'gap' as kind, 2 as o, event_id as id from (select *, us - lag(us) over (partition by user_id order by us, event_id) as gap from ev) where gap > 43200000000) select kind, id from (select * from p union all select * from q) order by o, id limit 15")
def _(t: Tables) -> DataFrame:
    near = j.band_pairs(t.ev, ["user_id"], "us", 30 * _MIN, "event_id", []).filter("a_us != b_us").select(F.lit("proximity").alias("kind"), F.lit(1).alias("o"), F.col("a_event_id").alias("id"))
    quiet = s.gaps(t.ev, "user_id", "us", "event_id", 720 * _MIN).select(F.lit("gap").alias("kind"), F.lit(2).alias("o"), F.col("event_id").alias("id"))
    return near.unionByName(quiet).orderBy("o", "id").limit(15).select("kind", "id")


@query("da14_case_places", f"with dd as (select p.id as a, q.id as b, p.lat, p.lon, q.lat as lat2, q.lon as lon2 from place p join place q on p.id < q.id), k as (select a, b, {_KM.format(r=6371.0088)} as km from dd) select a, b, case when km <= 0.05 then 'same place' else 'near' end as kind from k where km <= 1500")
def _(t: Tables) -> DataFrame:
    p = j.within_km(t.place, "id", 1500.0, m.config.RADIUS_CASE)
    return p.select("a", "b", F.when(F.col("km") <= m.config.CO_LOCATION_KM, "same place").otherwise("near").alias("kind"))


@query("da15_gaps", "with g as (select 'relationship' as kind, case_id, id from entity where id not in (select src from relation union all select dst from relation) union all select 'evidence', case_id, id from relation r where not exists (select 1 from evidence e where e.source_reference = 'candidate:' || r.candidate_id)), r as (select *, row_number() over (partition by kind, case_id order by id) as n from g) select kind, case_id, id from r where n <= 5")
def _(t: Tables) -> DataFrame:
    return s.first_of_each(d.gap_findings(t.entity, t.relation, t.evidence), ["kind", "case_id"], ["id"], 5, "n").drop("n")


_CASES = "cz as (select e.case_id, evidence, documents, relations, entities, conflicts from (select case_id, count(*) as evidence, count(document_id) as documents from evidence group by 1) e join (select case_id, count(*) as relations, count(*) filter (confidence < .01) as conflicts from relation group by 1) r using (case_id) join (select case_id, count(*) as entities from entity group by 1) n using (case_id))"


@query("da16_hypothesis_score", f"with {_CASES}, sc as (select case_id, .30 * least(1.0, evidence / 4.0) + .20 * least(1.0, relations / 3.0) + .20 * (1 - least(1.0, conflicts / 2.0)) + .15 * documents / evidence + .15 * least(1.0, entities / 5.0) as score from cz) select case_id, round(score::double, 9) as score, case when score >= .67 then 'high' when score >= .34 then 'medium' else 'low' end as band from sc")
def _(t: Tables) -> DataFrame:
    e = t.evidence.groupBy("case_id").agg(F.count("*").alias("evidence"), F.count("document_id").alias("documents"))
    r = t.relation.groupBy("case_id").agg(F.count("*").alias("relations"), F.count_if(F.col("confidence") < 0.01).alias("conflicts"))
    cases = e.join(r, "case_id").join(t.entity.groupBy("case_id").agg(F.count("*").alias("entities")), "case_id")
    return d.hypotheses(cases).withColumn("score", F.round("score", 9))


@query("da17_hypothesis_candidates", "with r as (select case_id, src, dst, count(*) as n, row_number() over (partition by case_id order by count(*) desc, src, dst) as place from relation where src <> dst group by 1, 2, 3) select case_id, src, dst, v as variant from r cross join (select unnest(['linked', 'coincidence']) as v) where place <= 3")
def _(t: Tables) -> DataFrame:
    r = t.relation.filter("src != dst").groupBy("case_id", "src", "dst").agg(F.count("*").alias("n"))
    top = s.first_of_each(r, ["case_id"], [F.desc("n"), F.asc("src"), F.asc("dst")], 3, "place")
    return top.select("case_id", "src", "dst", F.explode(F.array(F.lit("linked"), F.lit("coincidence"))).alias("variant"))


@query("da19_evidence_impact", "with r as (select 'candidate:' || candidate_id as ref, count(*) as n, count(distinct kind) as kinds from relation where candidate_id is not null group by 1) select e.id, (.5 * least(1.0, coalesce(n, 0) / 4.0) + case when document_id is not null then .125 else 0 end + case when kinds > 1 then .125 else 0 end)::double as score from evidence e left join r on e.source_reference = r.ref")
def _(t: Tables) -> DataFrame:
    return d.evidence_impact(t.evidence, t.relation)


@query("da20_removal", "with e as (select source_reference, evidence_type = 'DOCUMENT' as out from evidence), r as (select least(src, dst) as a, greatest(src, dst) as b, candidate_id, e.out from relation left join e on e.source_reference = 'candidate:' || candidate_id where src <> dst) select a, b, bool_or(coalesce(out, false)) and not bool_or(coalesce(not out, false)) and not bool_or(candidate_id is null) as gone from r group by 1, 2")
def _(t: Tables) -> DataFrame:
    return d.sole_provenance(t.relation, t.evidence, F.col("evidence_type") == "DOCUMENT")


@query("da21_counterfactual", "with a as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from relation where src <> dst group by 1, 2), w as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from relation where src <> dst and candidate_id is not null group by 1, 2) select a.a, a.b, case when w.a is null then 'removed' when a.n <> w.n then 'changed' else 'same' end as status from a left join w on a.a = w.a and a.b = w.b")
def _(t: Tables) -> DataFrame:
    def edges(r: DataFrame) -> DataFrame:
        return g.pair_rollup(r, "src", "dst", F.count("*").alias("n")).select(F.struct("a", "b").alias("edge"), "n")

    return j.full_diff(edges(t.relation), edges(t.relation.filter("candidate_id is not null")), "edge", ["n"]).select("edge.a", "edge.b", "status")


@query("da22_entity_profile", "with r as (select src as id, kind, dst as other from relation union all select dst, kind, src from relation) select e.id, e.name, count(r.id) as relations, count(distinct r.kind) as kinds, count(distinct r.other) as others from entity e left join r on e.id = r.id group by 1, 2")
def _(t: Tables) -> DataFrame:
    r = t.relation.select(F.col("src").alias("i"), "kind", F.col("dst").alias("other")).unionAll(t.relation.select("dst", "kind", "src"))
    n = r.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("relations"), F.countDistinct("kind").alias("kinds"), F.countDistinct("other").alias("others"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("relations", "kinds", "others")}
    return t.entity.join(n, "id", "left").select("id", "name", "relations", "kinds", "others").withColumns(zero)


@query("da23_freshness", "select case_id, case when max(o) is null then 'never' when max(o) < max(l) then 'stale' else 'fresh' end as state from (select case_id, max(us) filter (event_type = 'signup') as o, max(us) as l from ev group by 1) group by 1")
def _(t: Tables) -> DataFrame:
    n = t.ev.groupBy("case_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("us"))).alias("o"), F.max("us").alias("l"))
    return n.select("case_id", F.when(F.col("o").isNull(), "never").when(F.col("o") < F.col("l"), "stale").otherwise("fresh").alias("state"))


@query("da24_orphan_identifiers", "select id, name from person where id not in (select src from pay)")
def _(t: Tables) -> DataFrame:
    return t.person.join(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("id")), "id", "left_anti").select("id", "name")


@query("da25_case_search", "select 'entity' as kind, id, name as label from entity where contains(lower(name), 'machinery 7') union all select 'event', event_id, event_type from ev where contains(lower(event_type), 'machinery 7')")
def _(t: Tables) -> DataFrame:
    e = f.searched(t.entity, "machinery 7", "name").select(F.lit("entity").alias("kind"), "id", F.col("name").alias("label"))
    return e.unionByName(f.searched(t.ev, "machinery 7", "event_type").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("label")))


# --- named questions ---------------------------------------------------------------------------------------------


@query("cq01_case_overview", "with n as (select case_id, entity_type, count(*) as n from entity group by 1, 2) select case_id, entity_type, n, .3 + .7 * least(1.0, sum(n) over (partition by case_id) / 20.0)::double as confidence from n")
def _(t: Tables) -> DataFrame:
    n = t.entity.groupBy("case_id", "entity_type").agg(F.count("*").alias("n"))
    total = n.groupBy("case_id").agg(F.sum("n").alias("total"))
    return n.join(total, "case_id").select("case_id", "entity_type", "n", (0.3 + 0.7 * F.least(F.lit(1.0), F.col("total") / 20.0)).alias("confidence"))


@query("cq02_entity_question", "with r as (select src as id from relation union all select dst from relation), n as (select id, count(*) as rels from r group by 1), v as (select user_id as id, count(*) as events from ev group by 1) select e.id, coalesce(rels, 0) as rels, coalesce(events, 0) as events, .4 + .15 * (least(1.0, coalesce(rels, 0) / 3.0) + least(1.0, coalesce(events, 0) / 3.0))::double as confidence from entity e left join n using (id) left join v using (id)")
def _(t: Tables) -> DataFrame:
    n = g.degrees(t.relation.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("degree", "rels")
    v = t.ev.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("events"))
    out = t.entity.select("id").join(n, "id", "left").join(v, "id", "left").na.fill(0, ["rels", "events"])
    share = lambda c: F.least(F.lit(1.0), F.col(c) / 3.0)
    return out.select("id", "rels", "events", (0.4 + 0.15 * (share("rels") + share("events"))).alias("confidence"))


@query("cq03_relationship_path")
def _(t: Tables) -> DataFrame:
    p = gr.shortest_paths(t.link, 2, 9, 4)
    return p.orderBy("hops", F.array_join("path", "-")).limit(1).select(F.array_join("path", "-").alias("path"), (1 - 0.15 * (F.col("hops") - 1)).alias("confidence"))


@query("cq04_neighbourhood", "with u as (select a as src, b as dst from link union all select b, a from link), n as (select distinct dst as id, 1 as distance from u where src = 4) select id, distance, .5 + .5 * least(1.0, count(*) over () / 10.0)::double as confidence from n")
def _(t: Tables) -> DataFrame:
    n = gr.neighbourhood(t.link, F.col("id") == 4, 1).filter("distance > 0")
    total = n.agg(F.count("*").alias("total"))  # one row
    return n.join(F.broadcast(total)).select("id", "distance", (0.5 + 0.5 * F.least(F.lit(1.0), F.col("total") / 10.0)).alias("confidence"))


@query("cq05_timeline", "select case_id, count(*) as total, count(*) filter (k % 7 > 0) as dated, .4 + .6 * count(*) filter (k % 7 > 0) / count(*)::double as confidence from ev group by 1")
def _(t: Tables) -> DataFrame:
    n = t.ev.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(F.col("k") % 7 > 0).alias("dated"))
    return n.withColumn("confidence", 0.4 + 0.6 * F.col("dated") / F.col("total"))


@query("cq06_contradictions", "select a.event_id as a, b.event_id as b, abs(a.us - b.us) <= 300000000 as high from ev a join ev b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and abs(a.us - b.us) <= 900000000 and a.k <> b.k order by 3 desc, 1, 2 limit 10")
def _(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["user_id", "event_type"], "us", 15 * _MIN, "event_id", ["k"]).filter("a_k != b_k")
    out = p.select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), (F.abs(F.col("a_us") - F.col("b_us")) <= 5 * _MIN).alias("high"))
    return out.orderBy(F.desc("high"), "a", "b").limit(10)


@query("cq07_gaps", "select case_id, count(*) as n from entity where id not in (select src from relation union all select dst from relation) group by 1")
def _(t: Tables) -> DataFrame:
    return d.gap_findings(t.entity, t.relation, t.evidence).filter("kind = 'relationship'").groupBy("case_id").agg(F.count("*").alias("n"))


@query("cq08_hypotheses", "select case_id, max(confidence) as score from relation where kind = 'OWNS' group by 1 order by 2 desc, 1")
def _(t: Tables) -> DataFrame:
    return t.relation.filter("kind = 'OWNS'").groupBy("case_id").agg(F.max("confidence").alias("score"))


@query("cq09_evidence_lookup", "select e.id, count(r.id) as relations, min(r.src) as first_subject from evidence e left join relation r on e.source_reference = 'candidate:' || r.candidate_id group by 1")
def _(t: Tables) -> DataFrame:
    r = t.relation.filter("candidate_id is not null").select(F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("source_reference"), F.col("id").alias("r"), "src")
    return t.evidence.join(r, "source_reference", "left").groupBy("id").agg(F.count("r").alias("relations"), F.min("src").alias("first_subject"))


@query("cq10_evidence_for_entity", "with x as (select r.src as entity, e.id from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id union select r.dst, e.id from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id) select entity, count(*) as n, .5 + .5 * least(1.0, count(*) / 5.0)::double as confidence from x group by 1")
def _(t: Tables) -> DataFrame:
    r = t.relation.filter("candidate_id is not null").select(F.explode(F.array("src", "dst")).alias("entity"), F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("source_reference"))
    n = r.join(t.evidence, "source_reference").select("entity", "id").distinct().groupBy("entity").agg(F.count("*").alias("n"))
    return n.withColumn("confidence", 0.5 + 0.5 * F.least(F.lit(1.0), F.col("n") / 5.0))


@query("cq11_locations", "select coalesce(p.name, 'REGION ' || r.r_regionkey) as name, coalesce(c.n, 0) as claims from place p full join region r on p.name = r.r_name left join (select k % 25 as id, count(*) as n from ev group by 1) c on c.id = p.id")
def _(t: Tables) -> DataFrame:
    c = t.ev.groupBy((F.col("k") % 25).alias("id")).agg(F.count("*").alias("n"))
    p = t.place.select("id", "name").join(t.region, F.col("name") == F.col("r_name"), "full_outer").join(c, "id", "left")
    return p.select(F.coalesce("name", F.concat(F.lit("REGION "), F.col("r_regionkey").cast("string"))).alias("name"), F.coalesce("n", F.lit(0)).alias("claims"))


@query("cq12_impact", "with e as (select source_reference, evidence_type = 'SURVEILLANCE' as out from evidence), r as (select least(src, dst) as a, greatest(src, dst) as b, candidate_id, e.out from relation left join e on e.source_reference = 'candidate:' || candidate_id where src <> dst), g as (select a, b, bool_or(coalesce(out, false)) and not bool_or(coalesce(not out, false)) and not bool_or(candidate_id is null) as gone from r group by 1, 2) select count(*) as pairs, count(*) filter (gone) as removed from g")
def _(t: Tables) -> DataFrame:
    x_ = d.sole_provenance(t.relation, t.evidence, F.col("evidence_type") == "SURVEILLANCE")
    return x_.agg(F.count("*").alias("pairs"), F.count_if("gone").alias("removed"))


@query("cq13_entity_search", "with h as (select id, name from entity where contains(lower(name), 'building 1 ')) select id, name, .4 + .6 * least(1.0, count(*) over () / 5.0)::double as confidence from h")
def _(t: Tables) -> DataFrame:
    h = t.entity.filter(F.contains(F.lower("name"), F.lit("building 1 ")))
    total = h.agg(F.count("*").alias("total"))  # one row
    return h.join(F.broadcast(total)).select("id", "name", (0.4 + 0.6 * F.least(F.lit(1.0), F.col("total") / 5.0)).alias("confidence"))


@query("cq14_citations", "select kind, src as cited, min(id) as first_id from relation group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.relation.groupBy("kind", F.col("src").alias("cited")).agg(F.min("id").alias("first_id"))


# --- workflow ----------------------------------------------------------------------------------------------------

_ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"), ("error", "view")]


@query("wf01_transitions", "with s as (select event_id, lag(event_type) over (partition by user_id order by us, event_id) as f, event_type as t from ev) select event_id from s where f is not null and f <> t and f || '>' || t not in ('signup>view', 'view>click', 'click>purchase', 'purchase>view', 'error>view')")
def _(t: Tables) -> DataFrame:
    moves = t.ev.select("event_id", F.lag("event_type").over(s.Window.partitionBy("user_id").orderBy("us", "event_id")).alias("from"), F.col("event_type").alias("to"))
    return d.bad_transitions(moves.filter(F.col("from").isNotNull()), _ALLOWED).select("event_id")


@query("wf03_stuck_jobs", "select event_id from ev where event_type = 'view' and us < (select max(us) from ev) - 900000000")
def _(t: Tables) -> DataFrame:
    now = t.ev.agg(F.max("us").alias("now"))  # one row
    return t.ev.filter("event_type = 'view'").join(F.broadcast(now)).filter(F.col("us") < F.col("now") - 15 * _MIN).select("event_id")


@query("wf04_accept_candidates", "select min(id) as id, case_id, entity_type, lower(name) as key from entity group by 2, 3, 4")
def _(t: Tables) -> DataFrame:
    return t.entity.groupBy("case_id", "entity_type", x.normalize_name(F.col("name")).alias("key")).agg(F.min("id").alias("id"))


@query("wf05_reject_cascade", "select id, case when src in (select id from entity where entity_type = 'VEHICLE') or dst in (select id from entity where entity_type = 'VEHICLE') then 'REJECTED' else 'PENDING' end as status from relation")
def _(t: Tables) -> DataFrame:
    out = t.entity.filter("entity_type = 'VEHICLE'").select("id")
    a, b = out.select(F.col("id").alias("src"), F.lit(True).alias("x")), out.select(F.col("id").alias("dst"), F.lit(True).alias("y"))
    r = t.relation.join(a, "src", "left").join(b, "dst", "left")
    return r.select("id", F.when(F.coalesce("x", "y"), "REJECTED").otherwise("PENDING").alias("status"))


@query("wf06_accept_relations", "select min(r.id) as id, r.src, r.dst, r.kind from relation r where src in (select id from entity where entity_type <> 'VEHICLE') and dst in (select id from entity where entity_type <> 'VEHICLE') group by 2, 3, 4")
def _(t: Tables) -> DataFrame:
    return f.within(t.relation, t.entity.filter("entity_type != 'VEHICLE'")).groupBy("src", "dst", "kind").agg(F.min("id").alias("id"))


@query("wf07_accept_match", "select id, case when id = min(id) over (partition by entity_type, lower(name)) then 'ACCEPTED' else 'SUPERSEDED' end as status from entity")
def _(t: Tables) -> DataFrame:
    e = t.entity.withColumn("key", x.normalize_name(F.col("name")))
    first = e.groupBy("entity_type", "key").agg(F.min("id").alias("first"))
    return e.join(first, ["entity_type", "key"]).select("id", F.when(F.col("id") == F.col("first"), "ACCEPTED").otherwise("SUPERSEDED").alias("status"))


@query("wf08_bulk_review", "select o_orderkey as item, case when r.id is null then 'NOT_FOUND' when r.candidate_id is null then 'SKIPPED' else 'ACCEPTED' end as result from orders left join relation r on o_orderkey = r.id")
def _(t: Tables) -> DataFrame:
    r = t.relation.select("id", "candidate_id")
    return t.orders.join(r, F.col("o_orderkey") == F.col("id"), "left").select(F.col("o_orderkey").alias("item"), F.when(F.col("id").isNull(), "NOT_FOUND").when(F.col("candidate_id").isNull(), "SKIPPED").otherwise("ACCEPTED").alias("result"))


@query("wf09_audit_chain", "select event_id, 2 as first_break from events where event_id % 7 = 0")
def _(t: Tables) -> DataFrame:
    # every event is a chain of two entries, of which some have been changed afterwards
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    kind = F.col("event_type")
    first = sha(kind)
    entries = F.array(
        F.struct(F.lit(1).alias("seq"), kind.alias("body"), F.lit("").alias("prev"), first.alias("own")),
        F.struct(F.lit(2).alias("seq"), F.when(F.col("event_id") % 7 == 0, "changed").otherwise(kind).alias("body"), first.alias("prev"), sha(F.concat(first, kind)).alias("own")),
    )
    log = t.ev.select("event_id", F.explode(entries).alias("e")).select("event_id", "e.*")
    return d.audit_breaks(log, "event_id", "seq", "body", "own", "prev")


@query("wf10_case_audit", "select event_id, user_id from events where cast(json_extract_string(props, '$.k') as int) = 7")
def _(t: Tables) -> DataFrame:
    return t.events.filter(F.get_json_object("props", "$.k").cast("int") == 7).select("event_id", "user_id")
