"""Ties between cases and between candidates and entities (GR25, JN24), rankings of what other queries find (TK01, TK02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as x
from casewright.operators import crosscase as c
from casewright.operators import graph as gr
from casewright.plans import graphs  # noqa: F401  (its queries are ranked here)
from casewright.plans.registry import ORACLE, QUERIES, query
from casewright.plans.standin import Tables

_CONNECTED = (
    "with cn as (select min(id) as node, entity_type, lower(name) as key from entity group by 2, 3), cm as (select e.id, e.case_id, cn.* from entity e join cn on cn.entity_type = e.entity_type and cn.key = lower(e.name)), "
    "se as (select distinct node, entity_type, key, case_id from cm), u as (select a, b from pair union all select b, a from pair), ed as (select distinct x.node, y.node as near from u join cm x on x.id = u.a join cm y on y.id = u.b where x.node <> y.node), "
    "nb as (select ed.node, se.case_id, list_sort(list(near)) as near from ed join se on se.node = ed.near group by 1, 2), "
    "bo as (select x.case_id as case_a, y.case_id as case_b, x.node, x.entity_type, x.key, (select min((p.l, q.r)) from (select unnest(l.near) as l) p, (select unnest(r.near) as r) q where p.l <> q.r) as ends "
    "from se x join se y on x.node = y.node and x.case_id <> y.case_id left join nb l on l.node = x.node and l.case_id = x.case_id left join nb r on r.node = y.node and r.case_id = y.case_id), "
    "be as (select case_a, case_b, count(*) as shared, list_transform(list((key) order by entity_type, key)[1:4], lambda n: n) as names, arg_min([ends[1], node, ends[2]], (entity_type, key)) filter (ends is not null) as path from bo group by 1, 2), "
    "br as (select *, row_number() over (partition by case_a order by case_b) as r from be)"
)


@query("gr25_case_connections", _CONNECTED + " select case_a, case_b, case when path is null then 'shared_entity' else 'shared_path' end as kind, shared, names, path from br where r <= 12")
def _(t: Tables) -> DataFrame:
    """Every two cases that share an identity: how many, the first names, and a path from one case over a shared identity to the other."""
    return c.connections(t.entity, t.pair)


_KINDS = {"VEHICLE": "vehicle", "ORGANIZATION": "account"}
_TIED = "as (select distinct x.id, case e.entity_type when 'VEHICLE' then 'vehicle' else 'account' end as kind, lower(e.name) as identifier from (select src as id, dst as other from {0} union select dst, src from {0}) x join entity e on e.id = x.other where e.entity_type in ('VEHICLE', 'ORGANIZATION') and x.id in (select id from entity))"
_SHARED = (
    "with r1 as (select * from relation where candidate_id is null), r2 as (select * from relation where candidate_id is not null), "
    f"s1 {_TIED.format('r1')}, s2 {_TIED.format('r2')}, pq as (select a.id as candidate, b.id as entity from entity a join entity b on a.entity_type = b.entity_type and a.case_id = b.case_id and a.id < b.id and split_part(lower(a.name), ' ', 1) = split_part(lower(b.name), ' ', 1) and floor(a.id / 80) = floor(b.id / 80)), "
    "sh as (select candidate, entity, s1.kind, s1.identifier from pq join s1 on s1.id = candidate join s2 on s2.id = entity and s2.kind = s1.kind and s2.identifier = s1.identifier)"
)


def _shared(t: Tables) -> DataFrame:
    """The pairs to compare have one type, case and first word, and are of one block of ids."""
    said, known = (c.associations(t.entity, t.relation.filter(f"candidate_id is {which}"), _KINDS) for which in ("null", "not null"))
    e = t.entity.select("id", "entity_type", "case_id", F.get(F.split(x.normalize_name(F.col("name")), " "), 0).alias("word"), F.floor(F.col("id") / 80).alias("block"))
    keys = ["entity_type", "case_id", "word", "block"]
    pairs = e.withColumnRenamed("id", "candidate").join(e.withColumnRenamed("id", "entity"), keys).filter("candidate < entity")
    return c.shared_identifiers(pairs, said, known)


@query("jn24_shared_associations", _SHARED + " select candidate, entity, kind, identifier from sh")
def _(t: Tables) -> DataFrame:
    """The identifiers that a candidate's unconfirmed relations share with the confirmed ones of an entity it may be."""
    return _shared(t)


@query("jn24_context_bonus", _SHARED + " select candidate, entity, (case when bool_or(kind = 'vehicle') then .20 else 0 end + case when bool_or(kind = 'account') then .15 else 0 end)::double as bonus from sh group by 1, 2")
def _(t: Tables) -> DataFrame:
    """What shared identifiers add to the likeness of a candidate and an entity."""
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    return _shared(t).groupBy("candidate", "entity").agg(x.context_bonus(has("vehicle"), has("account"), F.lit(False)).alias("bonus"))


@query("tk02_top_cycles", f"select nodes, total from ({ORACLE['gr26_cycles']}) order by total desc, nodes limit 3")
def _(t: Tables) -> DataFrame:
    """The three payment cycles of the largest totals, ties by their members."""
    found = gr.cycles(t.flow, 1_000_000).select(F.array_join("nodes", "-").alias("nodes"), "total")
    return found.orderBy(F.desc("total"), "nodes").limit(3)


@query("tk01_top_influence", f"select id, score from ({ORACLE['gr07_influence']}) order by score desc, id limit 15")
def _(t: Tables) -> DataFrame:
    """The fifteen entities of most influence, ties by id."""
    return QUERIES["gr07_influence"](t.spark, t.sf_dir).select("id", "score").orderBy(F.desc("score"), "id").limit(15)
