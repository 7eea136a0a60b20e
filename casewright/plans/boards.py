"""The dashboard's blocks, the search over all kinds of rows and the order of a queue's claims (AG12, TK07, WF02)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import aggregates as g
from casewright.operators import joins as j
from casewright.operators import sequences as s
from casewright.plans.registry import query
from casewright.plans.sequences import _HITS
from casewright.plans.standin import Tables

_MIN = 60_000_000
_PROOF = "pf as (select least(src, dst) as a, greatest(src, dst) as b, evidence_type from relation r join evidence e on e.source_reference = 'candidate:' || r.candidate_id where src <> dst)"
_FOUND = "fd as (select a.event_type as kind, case when abs(a.us - b.us) <= 300000000 then 'HIGH' else 'MEDIUM' end as severity from ev a join ev b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and abs(a.us - b.us) <= 900000000 and a.k <> b.k)"


def _proofs(t: Tables) -> DataFrame:
    r = t.relation.filter("src != dst").withColumn("source_reference", F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string"))).join(t.evidence.select("source_reference", "evidence_type"), "source_reference")
    return r.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "evidence_type")


def _found(t: Tables) -> DataFrame:
    p = j.band_pairs(t.ev, ["user_id", "event_type"], "us", 15 * _MIN, "event_id", ["k"]).filter("a_k != b_k")
    return p.select(F.col("event_type").alias("kind"), F.when(F.abs(F.col("a_us") - F.col("b_us")) <= 5 * _MIN, "HIGH").otherwise("MEDIUM").alias("severity"))


@query(
    "ag12_tiles",
    "select 'cases' as tile, count(distinct case_id) as n from entity union all select 'entities', count(*) from entity union all select 'relations', count(*) from relation union all select 'evidence', count(*) from evidence union all select 'events', count(*) from events",
)
def _(t: Tables) -> DataFrame:
    tile = lambda name, df, n="count(*)": df.agg(F.expr(n).alias("n")).select(F.lit(name).alias("tile"), "n")
    tiles = [tile("cases", t.entity, "count(distinct case_id)"), tile("entities", t.entity), tile("relations", t.relation), tile("evidence", t.evidence), tile("events", t.ev)]
    return reduce(DataFrame.unionByName, tiles)


@query("ag12_severities", f"with {_FOUND} select z.severity, count(fd.kind) as n from (select unnest(['HIGH', 'MEDIUM', 'LOW']) as severity) z left join fd using (severity) group by 1")
def _(t: Tables) -> DataFrame:
    return g.zero_filled(_found(t).groupBy("severity").agg(F.count("*").alias("n")), "severity", ["HIGH", "MEDIUM", "LOW"], "n")


@query("ag12_findings_by_type", f"with {_FOUND} select kind, count(*) as n, count(*) filter (severity = 'HIGH') as high from fd group by 1")
def _(t: Tables) -> DataFrame:
    return _found(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "HIGH").alias("high"))


@query("ag12_by_source", f"with {_PROOF} select evidence_type as source, count(distinct (a, b)) as edges, count(*) as observations from pf group by 1")
def _(t: Tables) -> DataFrame:
    return _proofs(t).groupBy("evidence_type", "a", "b").agg(F.count("*").alias("n")).groupBy(F.col("evidence_type").alias("source")).agg(F.count("*").alias("edges"), F.sum("n").alias("observations"))


@query("ag12_corroboration", f"with {_PROOF}, n as (select least(count(distinct evidence_type), 4) as sources from pf group by a, b) select z.sources, count(n.sources) as pairs from (select unnest([1, 2, 3, 4]) as sources) z left join n using (sources) group by 1")
def _(t: Tables) -> DataFrame:
    """Pairs by the number of sources that prove them; 4 stands for four or more."""
    by = _proofs(t).groupBy("a", "b").agg(F.countDistinct("evidence_type").alias("sources")).groupBy(F.least("sources", F.lit(4)).cast("int").alias("sources")).agg(F.count("*").alias("pairs"))
    return g.zero_filled(by, "sources", [1, 2, 3, 4], "pairs")


@query(
    "ag12_weeks_filled",
    "with x as (select cast(date_trunc('week', ts) as date) as week, event_type from ev where event_type in ('signup', 'error') and k < 3), z as (select cast(unnest(generate_series(min(week)::timestamp, max(week)::timestamp, interval 7 day)) as date) as week from x) "
    "select z.week, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'signup') as signups from z left join x using (week) group by 1",
)
def _(t: Tables) -> DataFrame:
    """Two series by week from Monday on, with 0 for the weeks without a row."""
    few = t.ev.filter("event_type in ('signup', 'error') and k < 3")
    return g.weekly(few, "ts", {"errors": F.col("event_type") == "error", "signups": F.col("event_type") == "signup"})


@query("ag12_top", "select id, count(*) as degree from (select a as id from pair union all select b from pair) group by 1 order by 2 desc, 1 limit 8")
def _(t: Tables) -> DataFrame:
    return g.degrees(t.pair.select("a", "b")).orderBy(F.desc("degree"), "id").limit(8)


_STEPS = {"relations": "true", "with a candidate": "candidate_id is not null", "with a confidence": "candidate_id is not null and confidence is not null", "likely": "candidate_id is not null and confidence >= 0.5"}


@query("ag12_funnel", " union all ".join(f"select '{name}' as step, count(*) filter ({test}) as n from relation" for name, test in _STEPS.items()))
def _(t: Tables) -> DataFrame:
    one = t.relation.agg(*[F.count_if(F.expr(test)).alias(name) for name, test in _STEPS.items()])
    return one.unpivot([], list(_STEPS), "step", "n")


#: Kinds of rows with their id, label and most hits.
_KINDS = [("place", "id", "name", 10), ("person", "id", "name", 15), ("entity", "id", "name", 10), ("nation", "n_nationkey", "n_name", 10), ("region", "r_regionkey", "r_name", 8), ("evidence", "id", "evidence_type", 8), ("relation", "id", "kind", 8), ("ev", "event_id", "event_type", 8)]


@query("tk07_search_all_kinds", "select * from (" + " union all ".join(_HITS.format(kind, key, label, "r", kind, most) for kind, key, label, most in _KINDS) + ") order by relevance desc, kind, label, id limit 40")
def _(t: Tables) -> DataFrame:
    found = s.search("r", [(kind, getattr(t, kind), key, label, most) for kind, key, label, most in _KINDS])
    return found.orderBy(F.desc("relevance"), "kind", "label", "id").limit(40)


@query("wf02_claim_order", "select event_id, (row_number() over (order by us, event_id) - 1) // 5 + 1 as claim from ev where event_type = 'signup'")
def _(t: Tables) -> DataFrame:
    """Which claim takes each queued job, if each takes the five oldest that none has taken before."""
    return s.ranked(t.ev.filter("event_type = 'signup'").select("event_id", "us"), ["us", "event_id"], "place").select("event_id", F.expr("(place - 1) div 5 + 1").alias("claim"))
