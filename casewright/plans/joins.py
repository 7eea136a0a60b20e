"""Joins over whole tables (JN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import measures as m
from casewright.functions import text as x
from casewright.operators import blocks
from casewright.operators import joins as j
from casewright.plans.registry import query
from casewright.plans.scalars import _skeleton_sql
from casewright.plans.standin import Tables
from casewright.storage import stored

_MIN = 60_000_000


@query("jn01_phone_owner", "select c.call_id, a.name as caller_name, b.name as callee_name from call c join person a on c.caller = a.id join person b on c.callee = b.id")
def _(t: Tables) -> DataFrame:
    own = t.person.select("id", "name")
    a, b = own.toDF("a", "caller_name"), own.toDF("b", "callee_name")
    return t.call.join(a, F.col("caller") == F.col("a")).join(b, F.col("callee") == F.col("b")).select("call_id", "caller_name", "callee_name")


@query("jn02_account_else_name", "select o_orderkey, coalesce(s.s_name, c.c_name) as party from orders left join supplier s on o_orderkey = s_suppkey left join customer c on o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    first = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    second = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return j.with_fallback(t.orders, F.col("o_orderkey"), first, F.col("o_custkey"), second, "party").select("o_orderkey", "party")


def _said(t: Tables) -> DataFrame:
    """Names as they are written down: two of three with another spelling of the same sound."""
    return t.entity.select("id", F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.replace(F.col("name"), F.lit("I"), F.lit("EE"))).alias("said"))


_SOUNDS = f"sk as (select id, name, lower(name) as exact, w from entity, unnest(string_split(lower(name), ' ')) u(w)), kk as (select id, any_value(exact) as exact, string_agg({_skeleton_sql('w')}, ' ' order by {_skeleton_sql('w')}) filter ({_skeleton_sql('w')} <> '') as sound from sk group by 1)"


@query("jn03_resolve_name", f"with {_SOUNDS}, u as (select exact as k, min(id) as v from kk group by 1 having count(distinct id) = 1), y as (select sound as k, min(id) as v from kk group by 1 having count(distinct id) = 1), s as (select e.id, case when e.id % 3 = 0 then lower(name) else replace(lower(name), 'i', 'ee') end as said, sound from entity e join kk using (id)) select s.id, coalesce(u.v, y.v) as resolved from s left join u on s.said = u.k left join y on s.sound = y.k")
def _(t: Tables) -> DataFrame:
    """Exact name, else the sounds of its words if exactly one owner has them."""
    exact, sound = x.normalize_name(F.col("name")), x.name_key(F.col("name"))
    said = _said(t)
    return j.with_fallback(said, x.normalize_name(F.col("said")), j.unique_keys(t.entity, exact), x.name_key(F.col("said")), j.unique_keys(t.entity, sound), "resolved").select("id", "resolved")


@query("jn04_shared_device", "with d as (select distinct imei, caller from call where imei is not null) select a.caller as a, b.caller as b, count(*) as devices from d a join d b on a.imei = b.imei and a.caller < b.caller group by 1, 2")
def _(t: Tables) -> DataFrame:
    d = stored(t.call.filter("imei is not null and caller is not null").select("imei", "caller").distinct(), "devices")
    held = d.groupBy("imei").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")) / 2).first()[0] or 0
    if held > blocks.FEW_PAIRS:
        many, n = blocks.number_of_blocks(d, "caller")
        if blocks.worth(held, many, n):
            met = blocks.shared_items(d.select(F.col("caller").alias("who"), F.col("imei").cast("long").alias("item")), many)
            return met.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("n").alias("devices"))
    pairs = d.withColumnRenamed("caller", "a").join(d.withColumnRenamed("caller", "b"), "imei").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("devices"))


@query("jn05_co_mention", "with m as (select distinct l_orderkey, l_suppkey from lineitem) select a.l_suppkey as a, b.l_suppkey as b, count(*) as n from m a join m b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2")
def _(t: Tables) -> DataFrame:
    m_ = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    pairs = m_.withColumnRenamed("l_suppkey", "a").join(m_.withColumnRenamed("l_suppkey", "b"), "l_orderkey").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("jn06_proximity_pairs", "select a.event_id as a, b.event_id as b from ev a join ev b on a.user_id = b.user_id and a.event_id < b.event_id and abs(a.us - b.us) <= 600000000")
def _(t: Tables) -> DataFrame:
    return j.band_pairs(t.ev, ["user_id"], "us", 10 * _MIN, "event_id", []).select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"))


@query("jn07_nearest_preceding", "select a.event_id, arg_max(b.event_id, b.us) as last_seen from ev a left join ev b on a.user_id = b.user_id and b.event_type = 'click' and b.us <= a.us and a.us - b.us <= 7200000000 where a.event_type = 'error' group by 1")
def _(t: Tables) -> DataFrame:
    errors = t.ev.filter("event_type = 'error'")
    seen = t.ev.filter("event_type = 'click'").withColumn("seen", F.col("event_id"))
    return j.preceding(errors, seen, "user_id", "us", 120 * _MIN, "seen", "event_id").select("event_id", "last_seen")


_NEAR = "select event_type, a.event_id as a, b.event_id as b, a.user_id as user_a, b.user_id as user_b from ev a join ev b using (event_type) where a.event_id < b.event_id and a.user_id <> b.user_id and abs(a.us - b.us) <= 120000000"


@query("jn08_co_location", _NEAR)
def _(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["event_type"], "us", 2 * _MIN, "event_id", ["user_id"]).filter("a_user_id != b_user_id")
    return p.select("event_type", F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), F.col("a_user_id").alias("user_a"), F.col("b_user_id").alias("user_b"))


@query("jn09_custody_conflict", "with c as (select user_id, min(us) as since, case when user_id % 5 <> 0 then min(us) + 172800000000 end as until from ev where event_type = 'error' group by 1) select e.event_id, e.user_id from ev e join c on e.user_id = c.user_id and e.us between since and coalesce(until, 9000000000000000)")
def _(t: Tables) -> DataFrame:
    held = t.ev.filter("event_type = 'error'").groupBy("user_id").agg(F.min("us").alias("since"))
    held = held.withColumn("until", F.when(F.col("user_id") % 5 != 0, F.col("since") + 172_800_000_000))
    return t.ev.join(held, "user_id").filter(F.col("us").between(F.col("since"), F.coalesce("until", F.lit(9_000_000_000_000_000)))).select("event_id", "user_id")


@query("jn10_blocking_pairs", f"with k as (select distinct id, {_skeleton_sql('w')} as block from entity, unnest(string_split(lower(name), ' ')) u(w) where entity_type = 'PERSON'), p as (select distinct a.id as a, b.id as b from k a join k b on a.block = b.block and a.id < b.id and length(a.block) >= 3) select a, count(*) as n from p group by 1")
def _(t: Tables) -> DataFrame:
    """Pairs that share the sound of a word, counted by their first."""
    sounds = F.array_distinct(F.transform(F.split(F.lower("name"), " "), x.skeleton))
    k = t.entity.filter("entity_type = 'PERSON'").select("id", F.explode(sounds).alias("block")).filter("length(block) >= 3")
    return j.sharing_after(k)


@query("jn11_vehicle_conflict", "select k, a.event_id as a, b.event_id as b from ev a join ev b using (k) where a.event_id < b.event_id and a.user_id <> b.user_id and abs(a.us - b.us) <= 300000000 and not exists (select 1 from relation r where r.src = a.user_id and r.dst = b.user_id)")
def _(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["k"], "us", 5 * _MIN, "event_id", ["user_id"]).filter("a_user_id != b_user_id")
    explained = t.relation.select(F.col("src").alias("a_user_id"), F.col("dst").alias("b_user_id")).distinct()
    return p.join(explained, ["a_user_id", "b_user_id"], "left_anti").select("k", F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"))


@query("jn12_source_documents", "select e.id, d.source, d.n_chars from evidence e left join documents d on e.document_id = d.doc_id")
def _(t: Tables) -> DataFrame:
    return t.evidence.join(t.documents.select("doc_id", "source", "n_chars"), F.col("document_id") == F.col("doc_id"), "left").select("id", "source", "n_chars")


@query("jn13_location_entities", "with le as (select n_nationkey + 100 as entity, n_regionkey as case_id, lower(n_name) as k from nation where n_nationkey % 3 <> 0) select p.id, le.entity, le.entity is null as unmatched from place p left join le on p.case_id = le.case_id and trim(lower(p.name)) = le.k")
def _(t: Tables) -> DataFrame:
    """Places with the location entity of their case and normalised name; those without one are marked."""
    key = F.col("n_nationkey")
    named = t.nation.filter(key % 3 != 0).select((key + 100).alias("entity"), F.col("n_regionkey").alias("case_id"), x.normalize_name(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).alias("k"))
    p = t.place.select("id", "case_id", x.normalize_name(F.col("name")).alias("k"))
    return p.join(named, ["case_id", "k"], "left").select("id", "entity", F.col("entity").isNull().alias("unmatched"))


@query("jn14_events_with_places", "select e.case_id, count(*) as events, count(p.lon) as placed, count(*) - count(p.lon) as missing from ev e left join place p on e.k % 25 = p.id group by 1")
def _(t: Tables) -> DataFrame:
    e = t.ev.join(t.place.select("id", "lon"), F.col("k") % 25 == F.col("id"), "left")
    return e.groupBy("case_id").agg(F.count("*").alias("events"), F.count("lon").alias("placed"), (F.count("*") - F.count("lon")).alias("missing"))


@query("jn15_places_within_radius", "with d as (select p.id as a, q.id as b, 2 * 6371.0088 * asin(sqrt((pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) as km from place p join place q on p.id < q.id) select * from d where km <= 1500")
def _(t: Tables) -> DataFrame:
    return j.within_km(t.place, "id", 1500.0, m.config.RADIUS_CASE)


@query("jn16_evidence_of_entities", "select r.src as entity, e.id as evidence from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id")
def _(t: Tables) -> DataFrame:
    ref = t.relation.filter("candidate_id is not null").select(F.col("src").alias("entity"), F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("source_reference"))
    return ref.join(t.evidence, "source_reference").select("entity", F.col("id").alias("evidence"))


@query("jn17_shared_identity", "select a.entity_type, a.id as a, b.id as b from entity a join entity b on a.entity_type = b.entity_type and lower(a.name) = lower(b.name) and a.case_id < b.case_id")
def _(t: Tables) -> DataFrame:
    e = t.entity.withColumn("key", x.normalize_name(F.col("name"))).select("entity_type", "key", "id", "case_id")
    a, b = e.toDF("entity_type", "key", "a", "ca"), e.toDF("entity_type", "key", "b", "cb")
    return a.join(b, ["entity_type", "key"]).filter("ca < cb").select("entity_type", "a", "b")


_SNAP = "select o_custkey as id, count(*) as n, max(o_orderstatus) as status from orders where o_orderdate < timestamp '{}' group by 1"


def _snapshot(t: Tables, until: str) -> DataFrame:
    return t.orders.filter(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("status"))


@query("jn18_snapshot_diff", f"with a as ({_SNAP.format('1997-01-01')}), b as ({_SNAP.format('1999-01-01')}) select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' when a.n <> b.n or a.status <> b.status then 'changed' else 'same' end as status from a full join b on a.id = b.id")
def _(t: Tables) -> DataFrame:
    return j.full_diff(_snapshot(t, "1997-01-01"), _snapshot(t, "1999-01-01"), "id", ["n", "status"])


@query("jn19_counterfactual_edges", "with a as (select src, dst, count(*) as n from relation group by 1, 2), b as (select src, dst, count(*) as n from relation where kind <> 'CALLED' group by 1, 2) select a.src, a.dst, case when b.src is null then 'removed' when a.n <> b.n then 'changed' else 'same' end as status from a left join b on a.src = b.src and a.dst = b.dst")
def _(t: Tables) -> DataFrame:
    whole = t.relation.groupBy("src", "dst").agg(F.count("*").alias("n"))
    without = t.relation.filter("kind != 'CALLED'").groupBy("src", "dst").agg(F.count("*").alias("n"))
    key = F.struct("src", "dst").alias("edge")
    return j.full_diff(whole.select(key, "n"), without.select(key, "n"), "edge", ["n"]).select("edge.src", "edge.dst", "status")


@query("jn21_mutual_ownership", "with f as (select src, dst from flow) select a.src, a.dst from f a join f b on a.src = b.dst and a.dst = b.src and a.src < a.dst")
def _(t: Tables) -> DataFrame:
    return j.mutual(t.flow)


@query("jn22_claim_pairs", "select a.event_id as a, b.event_id as b, abs(a.us - b.us) / 6e7 as minutes from ev a join ev b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and abs(a.us - b.us) <= 900000000")
def _(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["user_id", "event_type"], "us", 15 * _MIN, "event_id", [])
    return p.select(F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), m.minutes_between(F.col("a_us"), F.col("b_us")).alias("minutes"))


@query("jn23_claim_location", "select e.event_id, coalesce(p.name, q.name, r.r_name, 'k' || e.k) as place from ev e left join place p on e.k = p.id left join place q on e.user_id = q.id left join region r on e.case_id = r.r_regionkey")
def _(t: Tables) -> DataFrame:
    p, q = t.place.select("id", "name").toDF("p", "pn"), t.place.select("id", "name").toDF("q", "qn")
    e = t.ev.join(p, F.col("k") == F.col("p"), "left").join(q, F.col("user_id") == F.col("q"), "left").join(t.region, F.col("case_id") == F.col("r_regionkey"), "left")
    return e.select("event_id", F.coalesce("pn", "qn", "r_name", F.concat(F.lit("k"), F.col("k").cast("string"))).alias("place"))


@query("jn24_shared_identifiers", "with a as (select distinct c_custkey as id, 'nation' as kind, c_nationkey as v from customer where c_custkey % 2 = 0 union all select c_custkey, 'segment', ascii(c_mktsegment) from customer where c_custkey % 2 = 0), b as (select s_suppkey as id, 'nation' as kind, s_nationkey as v from supplier) select a.id, count(distinct b.id) as suppliers from a join b on a.kind = b.kind and a.v = b.v group by 1")
def _(t: Tables) -> DataFrame:
    c = t.customer.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.explode(F.array(F.struct(F.lit("nation").alias("kind"), F.col("c_nationkey").alias("v")), F.struct(F.lit("segment").alias("kind"), F.ascii("c_mktsegment").alias("v")))).alias("x")
    )
    # the other side is counted by identifier first: only counts meet the candidates
    s = t.supplier.groupBy(F.lit("nation").alias("kind"), F.col("s_nationkey").alias("v")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    return c.select("id", "x.kind", "x.v").join(s, ["kind", "v"]).groupBy("id").agg(F.sum("suppliers").alias("suppliers"))


@query("jn25_evidence_chain", "select r.id, r.candidate_id, e.id as evidence, e.id is null as missing from relation r left join evidence e on e.source_reference = 'candidate:' || r.candidate_id where r.candidate_id is not null")
def _(t: Tables) -> DataFrame:
    r = t.relation.filter("candidate_id is not null").select("id", "candidate_id", F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("source_reference"))
    e = t.evidence.select(F.col("id").alias("evidence"), "source_reference")
    return r.join(e, "source_reference", "left").select("id", "candidate_id", "evidence", F.col("evidence").isNull().alias("missing"))


@query("jn26_review_queue", "select r.id, a.name as src_name, b.name as dst_name, r.confidence from relation r join entity a on r.src = a.id left join entity b on r.dst = b.id where r.candidate_id is null")
def _(t: Tables) -> DataFrame:
    a, b = t.entity.select("id", "name").toDF("src", "src_name"), t.entity.select("id", "name").toDF("dst", "dst_name")
    return t.relation.filter("candidate_id is null").join(a, "src").join(b, "dst", "left").select("id", "src_name", "dst_name", "confidence")


@query("jn27_indirect_pairs", "with u as (select a, b from pair union all select b, a from pair), h as (select distinct x.a as a, y.b as b from u x join u y on x.b = y.a and x.a < y.b) select h.a, h.b from h anti join pair p on h.a = p.a and h.b = p.b")
def _(t: Tables) -> DataFrame:
    return j.two_hops(t.pair.select("a", "b"))


_INDIRECT = "with u as (select a, b from pair union all select b, a from pair), h2 as (select distinct x.a as a, y.b as b from u x join u y on x.b = y.a and x.a <> y.b), d2 as (select h2.a, h2.b from h2 anti join u on h2.a = u.a and h2.b = u.b), h3 as (select distinct x.a as a, y.b as b from h2 x join u y on x.b = y.a and x.a <> y.b), d3 as (select h3.a, h3.b from h3 anti join u on h3.a = u.a and h3.b = u.b), f as (select a, b, 2 as length from d2 where a < b union all select d3.a, d3.b, 3 from d3 anti join d2 on d3.a = d2.a and d3.b = d2.b where d3.a < d3.b)"


@query("jn27_indirect_pairs_by_length", _INDIRECT + " select a, b, length from f")
def _(t: Tables) -> DataFrame:
    return j.indirect_pairs(t.pair.select("a", "b"))


@query("jn20_person_alignment")
def _(t: Tables) -> DataFrame:
    first = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    sig = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("sig"), F.row_number().over(first).alias("n"))
    other = sig.withColumn("id", F.when((F.col("id") % 7 == 0) & (F.col("n") > 3), -F.col("id")).otherwise(F.col("id")))
    return j.aligned(sig.select("id", "sig"), other.select("id", "sig"))
