"""Removal of evidence and second runs without some records (DA20, DA21, CQ12)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import aggregates as g
from casewright.operators import detectors as d
from casewright.operators import joins as j
from casewright.operators import provenance, whatif
from casewright.plans.graphs import _BETWEEN
from casewright.plans.identity import clusters_sql
from casewright.plans.registry import query
from casewright.plans.standin import Tables
from casewright.storage import stored

_MIN = 60_000_000


def _gone_by_kind(kind: str) -> str:
    """The pairs, and whether only evidence of ``kind`` proves them."""
    return (
        f"e as (select source_reference, evidence_type = '{kind}' as out from evidence), r as (select least(src, dst) as a, greatest(src, dst) as b, candidate_id, e.out from relation left join e on e.source_reference = 'candidate:' || candidate_id where src <> dst), "
        "g as (select a, b, bool_or(coalesce(out, false)) and not bool_or(coalesce(not out, false)) and not bool_or(candidate_id is null) as gone from r group by 1, 2)"
    )


def _metrics_sql(kind: str) -> str:
    return _metrics_of(_gone_by_kind(kind))


def _metrics_of(gone: str) -> str:
    """The metrics of every entity with all pairs and without those of g that are gone."""
    both = "{0} as (select a as src, b as dst from g {1} union all select b, a from g {1})"
    reach = "rc{0} as (select id, id as pos from entity union select rc{0}.id, u{0}.dst from rc{0} join u{0} on rc{0}.pos = u{0}.src), cc{0} as (select id, min(pos) as component from rc{0} group by 1), dg{0} as (select src as id, count(*) as degree from u{0} group by 1)"
    second = re.sub(r"\b([lk][0-9]+|u|bt|bw)\b", r"\1x", _BETWEEN)
    rows = (
        "mt as (select v.id, coalesce(dg.degree, 0) as degree, coalesce(dgx.degree, 0) as degree_after, bw.betweenness as betweenness, bwx.betweenness as betweenness_after, cc.component as component, ccx.component as component_after, "
        "coalesce(dg.degree, 0) > 0 and coalesce(dgx.degree, 0) = 0 as isolated from v join bw using (id) join bwx using (id) join cc using (id) join ccx using (id) left join dg using (id) left join dgx using (id))"
    )
    parts = [gone, both.format("u", ""), both.format("ux", "where not gone"), "v as (select id from entity), n as (select count(*) as n from entity)", _BETWEEN, second, reach.format(""), reach.format("x"), rows]
    return "with " + ", ".join(parts)


def _metrics(t: Tables, kind: str) -> DataFrame:
    pairs = d.sole_provenance(t.relation, t.evidence, F.col("evidence_type") == kind)
    return whatif.removal_metrics(pairs, pairs.filter("gone"), t.entity)


@query("da20_removal_metrics", _metrics_sql("DOCUMENT") + " select id, degree, degree_after, round(betweenness, 9) as betweenness, round(betweenness_after, 9) as betweenness_after, component, component_after, isolated from mt")
def _(t: Tables) -> DataFrame:
    return _metrics(t, "DOCUMENT").withColumns({c: F.round(c, 9) for c in ("betweenness", "betweenness_after")})


@query("da20_removal_disconnected", _metrics_sql("SURVEILLANCE") + " select x.id as a, y.id as b from mt x join mt y on x.component = y.component and x.component_after <> y.component_after and x.id < y.id order by 1, 2 limit 25")
def _(t: Tables) -> DataFrame:
    return whatif.disconnected_pairs(_metrics(t, "SURVEILLANCE"), 25)


@query(
    "cq12_impact_metrics",
    _metrics_sql("SURVEILLANCE") + " select count(distinct component) as components, count(distinct component_after) as components_after, count(*) filter (isolated) as isolated, count(*) filter (degree <> degree_after or abs(betweenness - betweenness_after) > 1e-12) as changed, "
    "(select count(*) from mt x join mt y on x.component = y.component and x.component_after <> y.component_after and x.id < y.id) as disconnected from mt",
)
def _(t: Tables) -> DataFrame:
    return whatif.removal_summary(_metrics(t, "SURVEILLANCE"))


def _findings_sql(n: str, ev: str) -> str:
    return (
        f"{n} as (select 'contradiction' as kind, a.event_id as a, b.event_id as b, case when abs(a.us - b.us) <= 300000000 then 'HIGH' else 'MEDIUM' end as grade from {ev} a join {ev} b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and abs(a.us - b.us) <= 900000000 and a.k <> b.k "
        f"union all select 'co-location', least(a.user_id, b.user_id), greatest(a.user_id, b.user_id), cast(count(*) as varchar) from {ev} a join {ev} b using (event_type) where a.event_id < b.event_id and a.user_id <> b.user_id and abs(a.us - b.us) <= 300000000 group by 2, 3 having count(*) >= 2 and count(distinct event_type) >= 2 "
        f"union all select 'identity', user_id, null, cast(count(distinct k) as varchar) from {ev} group by 2 having count(distinct k) >= 2)"
    )


def _findings(t: dict[str, DataFrame]) -> DataFrame:
    ev = t["events"]
    p = j.band_pairs(ev, ["user_id", "event_type"], "us", 15 * _MIN, "event_id", ["k"]).filter("a_k != b_k")
    soon = F.abs(F.col("a_us") - F.col("b_us")) <= 5 * _MIN
    said = p.select(F.lit("contradiction").alias("kind"), F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"), F.when(soon, "HIGH").otherwise("MEDIUM").alias("grade"))
    who = d.value_conflicts(ev, ["user_id"], "k").select(F.lit("identity").alias("kind"), F.col("user_id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("n").cast("string").alias("grade"))
    return said.unionByName(who)


@query(
    "da21_findings_again",
    f"with evx as (select * from ev where k % 10 <> 0 or k is null), {_findings_sql('f0', 'ev')}, {_findings_sql('f1', 'evx')} "
    "select coalesce(f0.kind, f1.kind) as kind, coalesce(f0.a, f1.a) as a, coalesce(f0.b, f1.b) as b, case when f0.kind is null then 'added' when f1.kind is null then 'removed' when f0.grade <> f1.grade then 'changed' else 'same' end as status "
    "from f0 full join f1 on f0.kind = f1.kind and f0.a = f1.a and f0.b is not distinct from f1.b",
)
def _(t: Tables) -> DataFrame:
    """Contradictions, meetings and conflicting identities again, without the records of one source."""
    gone = F.col("k") % 10 == 0
    met = d.co_location_again(t.ev, "user_id", "event_type", "us", "event_id", 5 * _MIN, 2, 2, gone)
    status = F.when(F.col("n").isNull(), "added").when(F.col("n_again").isNull(), "removed").when(F.col("n") != F.col("n_again"), "changed").otherwise("same")
    met = met.select(F.lit("co-location").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), status.alias("status"))
    return whatif.counterfactual({"events": t.ev}, {"events": gone}, _findings, ["kind", "a", "b"], ["grade"]).unionByName(met)


@query(
    "da21_links_again",
    "with evx as (select * from evidence where evidence_type <> 'CALL_RECORD'), f0 as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id where src <> dst group by 1, 2), "
    "f1 as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from relation r join evx e on e.source_reference = 'candidate:' || r.candidate_id where src <> dst group by 1, 2) "
    "select f0.a, f0.b, case when f1.a is null then 'removed' when f0.n <> f1.n then 'changed' else 'same' end as status from f0 left join f1 on f0.a = f1.a and f0.b = f1.b",
)
def _(t: Tables) -> DataFrame:
    """Pairs that evidence proves, with all sources and without the call records."""

    def proved(x: dict[str, DataFrame]) -> DataFrame:
        r = x["relations"].withColumn("source_reference", F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))).join(x["evidence"].select("source_reference"), "source_reference")
        return g.pair_rollup(r, "src", "dst", F.count("*").alias("n"))

    return whatif.counterfactual({"relations": t.relation, "evidence": t.evidence}, {"evidence": F.col("evidence_type") == "CALL_RECORD"}, proved, ["a", "b"], ["n"])


# --- one record goes -------------------------------------------------------------------------------------------------
_GROUNDS = (
    "dv as (select least(src, dst) as a, greatest(src, dst) as b, case when candidate_id is not null then e.id end as record, candidate_id is null as free from relation r left join evidence e on e.source_reference = 'candidate:' || r.candidate_id "
    "where src <> dst and (candidate_id is null or e.id is not null)), sg as (select a, b, min(record) as record from dv group by 1, 2 having count(distinct record) = 1 and not bool_or(free))"
)


def _derived(t: Tables) -> DataFrame:
    """Pairs by the evidence that grounds them; null for relations without a candidate. Candidates without evidence ground nothing."""
    e = t.evidence.select("source_reference", F.col("id").alias("record"))
    r = t.relation.filter("src != dst").withColumn("source_reference", F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))).join(e, "source_reference", "left")
    return r.filter("candidate_id is null or record is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "record")


@query("da20_sole_provenance", f"with {_GROUNDS} select a, b, record from sg")
def _(t: Tables) -> DataFrame:
    """Every pair that rests on one record of evidence alone, with that record: what the removal of any record takes away."""
    return provenance.sole_grounds(_derived(t), ["a", "b"])


@query("da20_provenance_index", f"with {_GROUNDS} select a, b, record, count(*) as n from dv where record is not null group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return provenance.grounds(_derived(t), ["a", "b"])


@query(
    "da20_removal_of_record",
    _metrics_of(_GROUNDS + ", g as (select pair.a, pair.b, sg.record is not null and sg.record = (select min(record) from sg) as gone from pair left join sg using (a, b))")
    + " select id, degree, degree_after, round(betweenness, 9) as betweenness, round(betweenness_after, 9) as betweenness_after, component, component_after, isolated from mt",
)
def _(t: Tables) -> DataFrame:
    """Degree, betweenness and component of every entity, with all evidence and without the first record on which a pair rests alone."""
    sole = stored(provenance.sole_grounds(_derived(t), ["a", "b"]), "sole")
    first = sole.agg(F.min("record").alias("record"))  # one row
    return whatif.removal_metrics(t.pair, sole.join(F.broadcast(first), "record"), t.entity).withColumns({c: F.round(c, 9) for c in ("betweenness", "betweenness_after")})


#: The record that goes from the case of observed people.
_GONE_RECORD = 7
_SECOND = f"ob as (select * from observed where record <> {_GONE_RECORD}), "
_REPORTS = "rp as (select id as report, src as a, dst as b, id % 50 as record, coalesce(confidence, .5) as weight from relation)"


def _links_sql(name: str, clusters: str, test: str) -> str:
    return f"{name} as (select least(p.entity, q.entity) as a, greatest(p.entity, q.entity) as b, count(*) as n, count(distinct record) as records from rp join {clusters} p on p.obs = rp.a join {clusters} q on q.obs = rp.b where p.entity <> q.entity and {test} group by 1, 2)"


_RUNS_SQL = (
    f"with recursive {clusters_sql('x', 'observed')}, {_SECOND}{clusters_sql('y', 'ob')}, {_REPORTS}, "
    "pt as (select x_c.entity as before, y_c.entity as after, count(*) as shared from x_c join y_c using (obs) group by 1, 2), pp as (select *, row_number() over (partition by before order by shared desc, after) as part from pt)"
)


def _observed_case(t: Tables) -> provenance.Case:
    reports = t.relation.select(F.col("id").alias("report"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("id") % 50).alias("record"), F.coalesce("confidence", F.lit(0.5)).alias("weight"))
    return provenance.build(t.observed.select("obs", "name", "record"), t.observed.select("obs", "ident"), reports)


def _without_record(t: Tables) -> tuple[provenance.Case, provenance.Case]:
    before = _observed_case(t)
    return before, provenance.without(before, t.spark.range(_GONE_RECORD, _GONE_RECORD + 1).toDF("record"))


@query(
    "da21_record_identities",
    _RUNS_SQL + ", sz as (select entity, count(*) as observations from x_c group by 1) select entity, observations, coalesce(sum(shared), 0)::bigint as \"left\", count(after) as parts, case when count(after) = 0 then 'gone' when count(after) > 1 then 'split' else 'smaller' end as status "
    "from sz left join pp on pp.before = sz.entity group by 1, 2 having coalesce(sum(shared), 0) < observations",
)
def _(t: Tables) -> DataFrame:
    """People whose identity one record touches: what is left of each, and whether it comes apart."""
    return provenance.identity_changes(*_without_record(t))


@query(
    "da21_record_links",
    _RUNS_SQL + f", {_links_sql('lx', 'x_c', 'true')}, {_links_sql('ly', 'y_c', f'record <> {_GONE_RECORD}')}, "
    "nw as (select least(case when p.part = 1 then p.before else p.after end, case when q.part = 1 then q.before else q.after end) as a, greatest(case when p.part = 1 then p.before else p.after end, case when q.part = 1 then q.before else q.after end) as b, "
    "n as n_after, records as records_after, p.part = 1 and q.part = 1 as stays from ly join pp p on p.after = ly.a join pp q on q.after = ly.b), ol as (select a, b, n, records, true as stays from lx) "
    "select a, b, n, n_after, records, records_after, case when n_after is null then 'removed' when n is null then 'introduced' else 'weakened' end as status from ol full join nw using (a, b, stays) where n is distinct from n_after or records is distinct from records_after",
)
def _(t: Tables) -> DataFrame:
    """Links between people that change when one record goes: by its reports, and by identities that come apart."""
    return provenance.link_changes(*_without_record(t))


@query("da21_record_scores")
def _(t: Tables) -> DataFrame:
    """Degree, betweenness, component, community, influence and place of every person, with all records and without one."""
    return provenance.score_changes(*_without_record(t))


@query(
    "cq12_record_impact",
    _RUNS_SQL + f", {_links_sql('lx', 'x_c', 'true')}, {_links_sql('ly', 'y_c', f'record <> {_GONE_RECORD}')} select (select count(distinct entity) from x_c) as subjects_before, (select count(distinct entity) from y_c) as subjects_after, (select count(*) from lx) as links_before, (select count(*) from ly) as links_after",
)
def _(t: Tables) -> DataFrame:
    """The summary of what goes with one record."""
    before, after = _without_record(t)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(before.entities, "subjects_before"), count(after.entities, "subjects_after"), count(before.links, "links_before"), count(after.links, "links_after")]
    return parts[0].join(parts[1]).join(parts[2]).join(parts[3])  # one row each
