"""Aggregations over whole tables (AG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators import aggregates as g
from casewright.plans.registry import query
from casewright.plans.standin import Tables


@query("ag01_call_pairs", "select least(caller, callee) as a, greatest(caller, callee) as b, count(*) as n, sum(secs) as secs, min(us) as first_us, max(us) as last_us, count(distinct tower) as towers from call where caller <> callee group by 1, 2")
def _(t: Tables) -> DataFrame:
    return g.pair_rollup(t.call, "caller", "callee", F.count("*").alias("n"), F.sum("secs").alias("secs"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct("tower").alias("towers"))


@query("ag02_shared_devices", "select imei, len(list_distinct(list(caller))) as owners, min(caller) as first_owner from call where imei is not null group by 1 having count(distinct caller) > 1")
def _(t: Tables) -> DataFrame:
    return g.shared_devices(t.call, "imei", "caller").select("imei", F.size("owners").cast("long").alias("owners"), F.get("owners", 0).alias("first_owner"))


@query("ag03_payment_pairs", "select src, dst, sum(amount) as amount, count(*) as n, count(distinct mode) as modes, min(txn_id) as first_txn, max(txn_id) as last_txn from pay group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.pay.groupBy("src", "dst").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.countDistinct("mode").alias("modes"), F.min("txn_id").alias("first_txn"), F.max("txn_id").alias("last_txn"))


@query("ag04_merged_edges", "with o as (select least(src, dst) as a, greatest(src, dst) as b, kind, confidence, id from relation where src <> dst), f as (select a, b, kind, min(id) as f from o group by 1, 2, 3) select o.a, o.b, count(*) as observations, max(confidence) as confidence, count(distinct o.id % 6) as sources, (select string_agg(kind, ',' order by f) from f where f.a = o.a and f.b = o.b) as types from o group by 1, 2")
def _(t: Tables) -> DataFrame:
    o = t.relation.select("src", "dst", F.col("kind").alias("type"), F.lit(1.0).alias("weight"), "confidence", F.lit(None).cast("timestamp").alias("ts"), (F.col("id") % 6).alias("source"), F.col("id").alias("seq"))
    return g.merged_edges(o).select("a", "b", "observations", "confidence", F.size("sources").cast("long").alias("sources"), F.array_join("types", ",").alias("types"))


@query("ag05_node_upsert", "select user_id, coalesce(arg_max(k, event_id) filter (k <> 0), arg_min(k, event_id)) as k, coalesce(arg_max(event_type, event_id), '') as event_type from ev group by 1")
def _(t: Tables) -> DataFrame:
    return g.upserted(t.ev, "user_id", "event_id", ["k", "event_type"])


@query("ag06_graph_stats", "select 'node' as what, entity_type as name, count(*) as n from entity group by 2 union all select 'edge', kind, count(*) from relation group by 2")
def _(t: Tables) -> DataFrame:
    return g.type_counts(t.entity, t.relation.select(F.array("kind").alias("types")), "entity_type", "types")


@query("ag07_corroboration", "select src, dst, count(distinct mode) as level, count(*) as n from pay group by 1, 2 having count(distinct mode) = 3")
def _(t: Tables) -> DataFrame:
    return t.pay.groupBy("src", "dst").agg(F.countDistinct("mode").alias("level"), F.count("*").alias("n")).filter("level = 3")


@query("ag08_bursts", "with d as (select event_type, cast(ts as date) as day, count(*) as n from ev group by 1, 2), s as (select *, (n - avg(n) over (partition by event_type)) / coalesce(nullif(stddev_pop(n) over (partition by event_type), 0), 1) as score, count(*) over (partition by event_type) as days from d) select event_type, day, n, score, case when score >= 2.5 then 'high' else 'medium' end as severity from s where days >= 5 and score >= 1.5 and n >= 6")
def _(t: Tables) -> DataFrame:
    days = t.ev.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return g.bursts(days, 1.5, 6, keys=["event_type"])


@query("ag09_burners", "with l as (select caller as number, callee as other, us from call union all select callee, caller, us from call), n as (select number, count(distinct other) as contacts, count(*) as calls, (max(us) - min(us)) // 86400000000 as days from l where number is not null and other is not null group by 1) select * from n where contacts <= 80 and days <= 29 and calls >= 3")
def _(t: Tables) -> DataFrame:
    return g.burners(t.call, 80, 29, 3)


@query("ag10_structuring", "select src_nation, dst_nation, count(*) as n, sum(gross) as total from pay where mode = 'R' and gross >= 42500 and gross < 50000 group by 1, 2 having count(*) >= 5")
def _(t: Tables) -> DataFrame:
    return g.structuring(t.pay.filter("mode = 'R'"), 50_000, 0.85, 5, ["src_nation", "dst_nation"])


@query("ag11_payment_digraph", "select src_nation as src, dst_nation as dst, sum(amount) as amount, count(*) as n from pay where src_nation <> dst_nation group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.pay.filter("src_nation != dst_nation").groupBy(F.col("src_nation").alias("src"), F.col("dst_nation").alias("dst")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


@query("ag12_weekly_activity", "with a as (select cast(date_trunc('week', ts) as date) as week, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type <> 'error') as others from ev group by 1) select * from a")
def _(t: Tables) -> DataFrame:
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    return t.ev.groupBy(week).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") != "error").alias("others"))


@query("ag13_candidate_counts", "select case_id, count(*) as total, count(candidate_id) as pending, count(distinct src) as subjects, sum(case when confidence >= .5 then 1 else 0 end)::bigint as likely from relation group by 1")
def _(t: Tables) -> DataFrame:
    return t.relation.groupBy("case_id").agg(F.count("*").alias("total"), F.count("candidate_id").alias("pending"), F.countDistinct("src").alias("subjects"), F.sum(F.when(F.col("confidence") >= 0.5, 1).otherwise(0)).alias("likely"))


_COUNTS = "select e.case_id, e.entities, r.relations, v.evidence from (select case_id, count(*) as entities from entity group by 1) e left join (select case_id, count(*) as relations from relation group by 1) r using (case_id) left join (select case_id, count(*) as evidence from evidence group by 1) v using (case_id)"


@query("ag14_case_counts", _COUNTS)
def _(t: Tables) -> DataFrame:
    n = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    return n(t.entity, "entities").join(n(t.relation, "relations"), "case_id", "left").join(n(t.evidence, "evidence"), "case_id", "left")


@query("ag15_entity_degree", "select id, count(*) as degree from (select src as id from relation union all select dst from relation) group by 1")
def _(t: Tables) -> DataFrame:
    return g.degrees(t.relation.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("ag16_latest_event", "select case_id, max(us) as latest from ev group by 1")
def _(t: Tables) -> DataFrame:
    return t.ev.groupBy("case_id").agg(F.max("us").alias("latest"))


@query("ag17_case_summary", "select case_id, count(*) as total, count(*) filter (evidence_type = 'DOCUMENT') as documents, count(document_id) as linked, count(*) filter (document_id is null) as unlinked from evidence group by 1")
def _(t: Tables) -> DataFrame:
    return t.evidence.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(F.col("evidence_type") == "DOCUMENT").alias("documents"), F.count("document_id").alias("linked"), F.count_if(F.col("document_id").isNull()).alias("unlinked"))


@query("ag18_diminishing_score", "with s as (select case_id, k % 2 as side, least(greatest(value / 100, 0.0), 1.0) * .6 / sqrt(row_number() over (partition by case_id, k % 2, event_type order by event_id)) as w from ev) select case_id, side, sum(w) as score from s group by 1, 2")
def _(t: Tables) -> DataFrame:
    from casewright.functions.measures import record_weight

    side = (F.col("k") % 2).alias("side")
    k = F.row_number().over(Window.partitionBy("case_id", F.col("k") % 2, "event_type").orderBy("event_id"))
    return t.ev.select("case_id", side, record_weight(F.lit(None).cast("double"), F.col("value") / 100, k).alias("w")).groupBy("case_id", "side").agg(F.sum("w").alias("score"))


@query("ag19_search_counts", "select what, count(*) as n from (select 'entity' as what from entity where contains(lower(name), '7') union all select 'place' from place where contains(lower(name), '7')) group by 1")
def _(t: Tables) -> DataFrame:
    hit = lambda df, what: df.filter(F.contains(F.lower("name"), F.lit("7"))).select(F.lit(what).alias("what"))
    return hit(t.entity, "entity").unionByName(hit(t.place, "place")).groupBy("what").agg(F.count("*").alias("n"))


@query("ag20_snapshot_counts", "select count(*) filter (o_orderdate < timestamp '1997-01-01') as before, count(*) filter (o_orderdate < timestamp '1999-01-01') as after from orders")
def _(t: Tables) -> DataFrame:
    at = lambda d: F.count_if(F.col("o_orderdate") < F.lit(d).cast("timestamp_ntz"))
    return t.orders.agg(at("1997-01-01").alias("before"), at("1999-01-01").alias("after"))


@query("ag21_majority_class", "select user_id, arg_max(event_type, (n, event_type)) as kind from (select user_id, event_type, count(*) as n from ev group by 1, 2) group by 1")
def _(t: Tables) -> DataFrame:
    n = t.ev.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.max(F.struct("n", "event_type"))["event_type"].alias("kind"))


@query("ag22_confidence_histogram", "select floor(confidence * 10)::int as bucket, count(*) as n from relation where confidence is not null group by 1")
def _(t: Tables) -> DataFrame:
    return t.relation.filter("confidence is not null").groupBy(F.floor(F.col("confidence") * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("ag23_stage_checklist", "select case_id, stage, done, total from (select case_id, count(candidate_id) as d1, count(confidence) as d2, count(*) as total from relation group by 1) cross join lateral (select unnest(['linked', 'scored']) as stage, unnest([d1, d2]) as done)")
def _(t: Tables) -> DataFrame:
    n = t.relation.groupBy("case_id").agg(F.count("candidate_id").alias("linked"), F.count("confidence").alias("scored"), F.count("*").alias("total"))
    return n.unpivot(["case_id", "total"], ["linked", "scored"], "stage", "done").select("case_id", "stage", "done", "total")


@query("ag24_case_detail", "with e as (select id, name from entity where case_id = 2 order by entity_type, name, id limit 25) select e.id, e.name, coalesce(d.degree, 0) as degree from e left join (select id, count(*) as degree from (select src as id from relation union all select dst from relation) group by 1) d using (id)")
def _(t: Tables) -> DataFrame:
    e = t.entity.filter("case_id = 2").orderBy("entity_type", "name", "id").limit(25).select("id", "name")
    d = g.degrees(t.relation.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return e.join(d, "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("ag25_case_registry", f"with c as ({_COUNTS}) select c.*, l.latest from c left join (select case_id, max(us) as latest from ev group by 1) l using (case_id)")
def _(t: Tables) -> DataFrame:
    n = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    c = n(t.entity, "entities").join(n(t.relation, "relations"), "case_id", "left").join(n(t.evidence, "evidence"), "case_id", "left")
    return c.join(t.ev.groupBy("case_id").agg(F.max("us").alias("latest")), "case_id", "left")


@query("ag26_finding_facets", "select kind, case when confidence >= .67 then 'high' when confidence >= .34 then 'medium' else 'low' end as severity, count(*) as n from relation group by 1, 2")
def _(t: Tables) -> DataFrame:
    from casewright.functions.measures import band

    return t.relation.groupBy("kind", band(F.col("confidence")).alias("severity")).agg(F.count("*").alias("n"))


@query("ag27_map_points", "select p.id, p.lat, p.lon, count(*) as links from place p join (select a as id from link union all select b from link) l using (id) where p.lat is not null and p.lon is not null group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    d = g.degrees(t.link).withColumnRenamed("degree", "links")
    return t.place.filter("lat is not null and lon is not null").join(d, "id").select("id", "lat", "lon", "links")


@query("ag28_mean_strength", "select e.case_id, coalesce(round(avg(r.confidence) * 100), 60.0) as strength from (select distinct case_id from entity) e left join relation r on e.case_id = r.case_id and r.kind = 'OWNS' group by 1")
def _(t: Tables) -> DataFrame:
    mean = t.relation.filter("kind = 'OWNS'").groupBy("case_id").agg(F.avg("confidence").alias("m"))
    return t.entity.select("case_id").distinct().join(mean, "case_id", "left").select("case_id", F.coalesce(F.round(F.col("m") * 100), F.lit(60.0)).alias("strength"))


@query("ag29_layout_size", "with d as (select id, count(*) as degree from (select a as id from link union all select b from link) group by 1) select id, ln(1 + degree) / ln(1 + max(degree) over ()) as size from d")
def _(t: Tables) -> DataFrame:
    d = g.degrees(t.link)
    most = d.agg(F.max("degree").alias("most"))  # one row
    return d.join(F.broadcast(most)).select("id", (F.log1p("degree") / F.log1p("most")).alias("size"))


@query("ag30_queue_depth", "select count(*) filter (event_type = 'signup') as queued, count(*) filter (event_type = 'view') as running, count(*) as jobs from ev")
def _(t: Tables) -> DataFrame:
    return t.ev.agg(F.count_if(F.col("event_type") == "signup").alias("queued"), F.count_if(F.col("event_type") == "view").alias("running"), F.count("*").alias("jobs"))
