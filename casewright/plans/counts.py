"""Counts of cases (AG14, AG20, AG23) and written dates and languages (SC20, SC21, SC25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import stamps
from casewright.operators import counts
from casewright.plans.copilot import _CASE_SQL, CaseTables
from casewright.plans.hypotheses import _HYPOTHESES, _hypotheses
from casewright.plans.registry import query
from casewright.plans.standin import Tables

_TABLES = {
    "documents": "select doc_id % 5 as case_id from documents", "entities": "select case_id from entity", "relationships": "select case_id from relation", "evidence": "select case_id from evidence", "timeline_events": "select case_id from ce",
    "locations": "select case_id from place", "hypotheses": "select case_id from hy where rank <= 12", "contradictions": "select case_id from said_twice", "gaps": "select case_id from entity where id not in (select src from relation union all select dst from relation)", "simulations": "select case_id from ce where kind = 'error'",
}


@query(
    "ag14_child_counts",
    _HYPOTHESES + f", {_CASE_SQL.replace('cf as', 'said_twice as')}, ch as (" + " union all ".join(f"select case_id, '{n}' as t from ({q})" for n, q in _TABLES.items()) + "), cg as (select case_id, " + ", ".join(f"count(*) filter (t = '{n}') as {n}" for n in _TABLES) + " from ch group by 1) "
    "select case_id, " + ", ".join(f"coalesce({n}, 0) as {n}" for n in _TABLES) + " from (select distinct case_id from entity) left join cg using (case_id)",
)
def _(t: Tables) -> DataFrame:
    """Rows of ten child tables of every case."""
    c = CaseTables(t)
    ends = t.relation.select(F.explode(F.array("src", "dst")).alias("id"))
    children = {
        "documents": t.documents.select((F.col("doc_id") % 5).alias("case_id")), "entities": t.entity, "relationships": t.relation, "evidence": t.evidence, "timeline_events": c.events,
        "locations": c.locations, "hypotheses": _hypotheses(t), "contradictions": c.findings, "gaps": t.entity.join(ends, "id", "left_anti"), "simulations": c.events.filter("kind = 'error'"),
    }
    return counts.child_counts(t.entity, children)


_SECTIONS = {"entities": ("entity", "name"), "relationships": ("relation", "confidence"), "evidence": ("evidence", "evidence_type"), "events": ("ce", "kind"), "findings": ("cf", "title"), "locations": ("place", "name")}


def _section_sql(name: str, table: str, field: str) -> str:
    now = "null" if field == "confidence" else "upper(x.f)"
    return (
        f"select '{name}' as section, count(*) filter (x.id is null) as added, count(*) filter (y.id is null) as removed, count(*) filter (x.id is not null and y.id is not null and x.f is distinct from y.f) as changed "
        f"from (select id, {field} as f from {table} where id % 7 <> 0) x full join (select id, case when id % 5 = 0 then {now.replace('x.f', field)} else {field} end as f from {table} where id % 11 <> 0) y on x.id = y.id"
    )


@query("ag20_section_changes", f"with {_CASE_SQL} " + " union all ".join(_section_sql(n, *s) for n, s in _SECTIONS.items()))
def _(t: Tables) -> DataFrame:
    """What was added, removed and changed in each section between two snapshots: the first lacks some rows, the second others, and has some of another value."""
    c = CaseTables(t)
    tables = {"entities": t.entity, "relationships": t.relation, "evidence": t.evidence, "events": c.events, "findings": c.findings, "locations": c.locations}
    before, after = {}, {}
    for name, (_, field) in _SECTIONS.items():
        rows = tables[name].select("id", field)
        before[name] = rows.filter("id % 7 != 0")
        other = F.lit(None).cast("double") if field == "confidence" else F.upper(field)
        after[name] = rows.filter("id % 11 != 0").withColumn(field, F.when(F.col("id") % 5 == 0, other).otherwise(F.col(field)))
    return counts.section_changes(before, after, {n: [f] for n, (_, f) in _SECTIONS.items()})


_STAGES = "ingestion text_extraction language_detection normalization entity_extraction relationship_extraction review_candidates".split()


@query(
    "ag23_document_stages",
    "with pn as (select distinct candidate_id as doc_id from relation where confidence is null), dx as (select doc_id % 5 as case_id, text is not null as s1, coalesce(length(text), 0) > 0 as s2, lang is not null as s3, coalesce(lang in ('en', 'de'), false) as s4, coalesce(n_chars > 100, false) as s5, coalesce(n_chars > 100, false) and doc_id not in (select doc_id from pn where doc_id is not null) as s7 from documents) "
    + " union all ".join(f"select case_id, '{n}' as stage, count(*) filter ({s}) as done, count(*) as total from dx group by 1" for n, s in zip(_STAGES, ["s1", "s2", "s3", "s4", "s5", "s5", "s7"], strict=True)),
)
def _(t: Tables) -> DataFrame:
    """Seven stages of the documents of each case; reviewed is what is processed and has no candidate pending."""
    pending = t.relation.filter("confidence is null and candidate_id is not null").select(F.col("candidate_id").alias("doc_id"), F.lit(True).alias("pending")).distinct()
    d = t.documents.withColumn("case_id", F.col("doc_id") % 5).join(pending, "doc_id", "left")
    done = F.col("n_chars") > 100
    tests = [F.col("text").isNotNull(), F.length("text") > 0, F.col("lang").isNotNull(), F.col("lang").isin("en", "de"), done, done, done & F.col("pending").isNull()]
    return counts.stage_checklist(d, dict(zip(_STAGES, tests, strict=True)))


@query(
    "sc20_event_stamps",
    "select o_orderkey, case when o_orderkey % 8 in (6, 7) then null else date_trunc('day', o_orderdate)::timestamp + case o_orderkey % 8 when 0 then to_seconds(o_orderkey % 86400) when 2 then to_seconds(o_orderkey % 86400) when 1 then to_seconds(o_orderkey % 86400 // 60 * 60) when 3 then to_seconds(o_orderkey % 86400 // 60 * 60) else to_seconds(0) end end as ts from orders",
)
def _(t: Tables) -> DataFrame:
    """Times in six layouts, with blanks around them, one text that is none and one null."""
    key = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))) + key % 86400)
    shapes = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "d/M/yyyy"]
    said = F.get(F.array(*[F.concat(F.lit(" "), F.date_format(at, s)) for s in shapes], F.lit("next Tuesday"), F.lit(None).cast("string")), (key % 8).cast("int"))
    return t.orders.select("o_orderkey", stamps.event_stamp(said).alias("ts"))


@query(
    "sc21_leading_stamps",
    "with k as (select o_orderkey, o_orderdate, o_orderkey % 10 as s, o_orderkey % 24 as h, o_orderkey % 60 as m from orders), h as (select *, case when s in (4, 5, 7) then 9 when s in (8, 9) then null else h end as hh, case when s in (4, 5, 7) then 0 when s in (8, 9) then null else m end as mm from k) "
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(hh::varchar, 2, '0') || ':' || lpad(mm::varchar, 2, '0') || ':00+05:30' as stamp, case when hh is not null then 'seen at the gate' end as rest from h",
)
def _(t: Tables) -> DataFrame:
    """Lines that begin with a date in one of four layouts, with a time in it, after it, with am or pm, or none; two that begin otherwise."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    h, m = (key % 24).cast("int"), (key % 60).cast("int")
    clock = F.format_string("%02d:%02d", h, m)
    half = F.concat(F.format_string("%d:%02d", F.when(h % 12 == 0, 12).otherwise(h % 12), m), F.when(h >= 12, " PM").otherwise(" am"))
    d = lambda f: F.date_format(day, f)
    said = [
        F.concat(d("yyyy-MM-dd"), F.lit("T"), clock, F.lit(" - seen at the gate")), F.concat(F.lit("• "), d("d/M/yyyy"), F.lit(", "), clock, F.lit(": seen at the gate")), F.concat(d("d MMM yyyy"), F.lit(" "), half, F.lit(" seen at the gate")),
        F.concat(d("MMMM d, yyyy"), F.lit(" – "), half, F.lit(" seen at the gate")), F.concat(d("dd-MM-yyyy"), F.lit("  seen   at the gate")), F.concat(d("MMM d yyyy"), F.lit(" | seen at the gate")),
        F.concat(d("yyyy-MM-dd"), F.lit(" ("), clock, F.lit(" hrs seen at the gate")), F.concat(F.lit("- "), d("d MMMM yyyy"), F.lit(" seen at the gate")), F.concat(F.lit("seen on "), d("yyyy-MM-dd")), F.concat(F.lit("2024-13-01 "), clock),
    ]
    found = stamps.leading_stamp(F.get(F.array(*said), (key % 10).cast("int")))
    return t.orders.select("o_orderkey", found.alias("f")).select("o_orderkey", "f.stamp", "f.rest")


@query(
    "sc25_text_language",
    "with x as (select obs, case obs % 4 when 0 then repeat(name || ' ', 4) when 1 then repeat(name || ' ', 4) || 'आहे' when 2 then '12 34' else name end as s from observed), n as (select obs, s, length(s) - length(regexp_replace(s, '[ऀ-ॿ]', '', 'g')) as d, length(s) - length(regexp_replace(s, '[A-Za-z]', '', 'g')) as l from x) "
    "select obs, case when d > l * .15 and d > 20 then case when regexp_matches(s, 'ळ|न्ही|आहे|यांच्या') then 'Marathi' else 'Hindi' end when l > 0 then 'English' end as language from n",
)
def _(t: Tables) -> DataFrame:
    k, long = F.col("obs") % 4, F.repeat(F.concat("name", F.lit(" ")), 4)
    text = F.when(k == 0, long).when(k == 1, F.concat(long, F.lit("आहे"))).when(k == 2, "12 34").otherwise(F.col("name"))
    return t.observed.select("obs", stamps.text_language(text).alias("language"))
