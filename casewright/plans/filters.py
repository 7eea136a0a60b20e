"""Filters and projections over whole tables (FLT)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import filters as f
from casewright.plans.registry import query
from casewright.plans.standin import Tables


def _edges(t: Tables) -> DataFrame:
    return t.relation.select("id", "src", "dst", "confidence", F.array("kind").alias("types"))


@query("flt01_graph_slice", "with v as (select id from entity where entity_type in ('PERSON', 'ORGANIZATION')) select id, src, dst from relation where confidence >= .3 and kind in ('CALLED', 'OWNS') and src in (select id from v) and dst in (select id from v)")
def _(t: Tables) -> DataFrame:
    v = t.entity.withColumnRenamed("entity_type", "kind")
    return f.graph_slice(v, _edges(t), ["PERSON", "ORGANIZATION"], 0.3, ["CALLED", "OWNS"])[1].select("id", "src", "dst")


@query("flt02_induced_subgraph", "with v as (select id from entity where entity_type <> 'VEHICLE') select id, src, dst from relation where src in (select id from v) and dst in (select id from v)")
def _(t: Tables) -> DataFrame:
    return f.within(t.relation, t.entity.filter("entity_type != 'VEHICLE'")).select("id", "src", "dst")


@query("flt03_findings_by_severity", "select txn_id, src, dst from pay where mode = 'R' and gross >= 42500 and gross < 50000")
def _(t: Tables) -> DataFrame:
    return t.pay.filter("mode = 'R' and gross >= 42500 and gross < 50000").select("txn_id", "src", "dst")


@query("flt04_corroborated", "select src, dst, count(distinct mode) as level from pay group by 1, 2 having count(distinct mode) >= 2")
def _(t: Tables) -> DataFrame:
    return t.pay.groupBy("src", "dst").agg(F.countDistinct("mode").alias("level")).filter("level >= 2")


@query("flt05_graph_payload", "with e as (select id from entity where entity_type = 'PERSON' order by id limit 200) select id, src, dst, confidence from relation where confidence >= .2 and src in (select id from e) and dst in (select id from e)")
def _(t: Tables) -> DataFrame:
    return f.graph_payload(t.entity, t.relation, None, 0.2, "PERSON", 200).select("id", "src", "dst", "confidence")


@query("flt06_timeline", "select event_id, user_id from ev where event_type = 'click' and ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-20'")
def _(t: Tables) -> DataFrame:
    return f.timeline(t.ev, "ts", "2024-01-10", "2024-01-20", event_type="click").select("event_id", "user_id")


@query("flt07_evidence_page", "select id, source_reference from evidence where evidence_type = 'DOCUMENT' order by id limit 25 offset 50")
def _(t: Tables) -> DataFrame:
    return f.page(t.evidence.filter("evidence_type = 'DOCUMENT'"), ["id"], 25, 50)[0].select("id", "source_reference")


@query("flt08_transactions_of_party", "select txn_id, amount from pay where src in (select id from person where segment = 'BUILDING') and amount >= 90000")
def _(t: Tables) -> DataFrame:
    big = t.pay.filter("amount >= 90000")
    return big.join(t.person.filter("segment = 'BUILDING'").select("id"), big.src == F.col("id"), "left_semi").select("txn_id", "amount")


@query("flt09_time_replay", "with e as (select src, dst, min(ts) as first_seen from pay group by 1, 2 having min(ts) <= timestamp '1996-06-01') select src as id, count(*) as edges from e group by 1")
def _(t: Tables) -> DataFrame:
    e = t.pay.groupBy("src", "dst").agg(F.min("ts").cast("timestamp_ntz").alias("first_seen"))
    return f.visible_at(e, "1996-06-01")[0].groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))


@query("flt10_case_access", "select id from (select c_custkey as id, case when c_acctbal >= 0 then c_nationkey end as owner from customer) where owner is null or owner = 7")
def _(t: Tables) -> DataFrame:
    cases = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("owner"))
    return f.accessible(cases, 7, "OFFICER").select("id")


@query("flt11_case_search", "select c_mktsegment as status, count(*) as n from customer where contains(lower(c_name || ' ' || c_mktsegment), '12') group by 1")
def _(t: Tables) -> DataFrame:
    return f.searched(t.customer, "12", "c_name", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("status")).agg(F.count("*").alias("n"))


@query("flt12_evidence_list", "select id from evidence where document_id is null and case_id = 3")
def _(t: Tables) -> DataFrame:
    return t.evidence.filter("document_id is null and case_id = 3").select("id")


@query("flt13_record_checked", "select id, prior_cases is not null as record_checked from person")
def _(t: Tables) -> DataFrame:
    return t.person.select("id", F.col("prior_cases").isNotNull().alias("record_checked"))


@query("flt14_page_with_total", "select id, name, (select count(*) from entity) as total from entity order by name, id limit 20 offset 40")
def _(t: Tables) -> DataFrame:
    rows, total = f.page(t.entity, ["name", "id"], 20, 40)
    return rows.select("id", "name", F.lit(total).cast("long").alias("total"))
