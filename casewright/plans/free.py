"""Queries without a SQL form: transliteration, likeness, reading of free text, questions, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.similarity import clock_times, long_sounds, match_latin, name_clusters, name_words, runs_to_latin, stated_time, to_latin, words_likeness
from casewright.operators import extract as e
from casewright.operators import graph as gr
from casewright.operators.sequences import first_of_each
from casewright.plans import ask
from casewright.plans.registry import query
from casewright.plans.standin import Tables
from casewright.storage import stored

# Consonants that stand for the digits of a key, in both scripts.
_DEVA, _LATIN = "कमलनरसतपवद", "kmlnrstpvd"


def _named(t: Tables) -> DataFrame:
    """(id, name, phone): a first name of a customer's number and a last one of the nation, in Devanagari for even numbers."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    digits = F.concat(F.lpad((key % 40).cast("string"), 4, "1"), F.lit(" "), F.lpad((nation * 37).cast("string"), 4, "2"))
    latin = F.regexp_replace(F.translate(digits, "0123456789", "kmlnrtspvd"), "([a-z])", "$1a")
    return t.customer.select(key.alias("id"), F.when(key % 2 == 0, F.translate(digits, "0123456789", _DEVA)).otherwise(F.initcap(latin)).alias("name"), (key % 50).alias("phone"))


_NAMES_SQL = (
    "dn as (select c_custkey as id, c_custkey % 50 as phone, lpad((c_custkey % 40)::varchar, 4, '1') || ' ' || lpad((c_nationkey * 37)::varchar, 4, '2') as digits from customer), "
    "nm as (select id, phone, digits, regexp_replace(translate(digits, '0123456789', 'kmlnrstpvd'), '([a-z])', '\\1a', 'g') as spoken, regexp_replace(translate(digits, '0123456789', 'kmlnrtspvd'), '([a-z])', '\\1a', 'g') as latin from dn)"
)


@query("sc03_devanagari_to_latin", f"with {_NAMES_SQL} select id, spoken as latin from nm where id % 2 = 0")
def _(t: Tables) -> DataFrame:
    return _named(t).filter("id % 2 = 0").select("id", to_latin("name").alias("latin"))


@query("sc04_transliterate_runs", f"with {_NAMES_SQL} select id, 'FIR 12: ' || case when id % 2 = 0 then spoken else array_to_string(list_transform(string_split(latin, ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as latin from nm")
def _(t: Tables) -> DataFrame:
    return _named(t).select("id", runs_to_latin(F.concat(F.lit("FIR 12: "), "name")).alias("latin"))


@query("sc07_second_transliterator", f"with {_NAMES_SQL} select id, array_to_string(list_transform(string_split(spoken, ' '), lambda w: w[:-2]), ' ') as latin from nm where id % 2 = 0")
def _(t: Tables) -> DataFrame:
    return _named(t).filter("id % 2 = 0").select("id", match_latin("name").alias("latin"))


def _alike(t: Tables) -> DataFrame:
    """(a, b, likeness) of different spellings that share a long sound: the sounds are the blocks."""
    spelled = stored(_named(t).select("name").distinct().withColumn("words", name_words("name")), "names")
    block = spelled.select("name", "words", F.explode(long_sounds(F.col("words"))).alias("sound"))
    pairs = block.toDF("a", "x", "sound").join(block.toDF("b", "y", "sound"), "sound").filter("a < b").dropDuplicates(["a", "b"])
    return pairs.select("a", "b", words_likeness(F.col("x"), F.col("y")).alias("likeness"))


@query("sc11_name_similarity")
def _(t: Tables) -> DataFrame:
    return _alike(t)


@query("sc18_clock_times", "select event_id, 10 as position, extract(hour from ts)::int as hour, extract(minute from ts)::int as minute from events union all select event_id, 23, 23, 59 from events union all select event_id, 38, 6, 15 from events union all select event_id, 41, 6, 15 from events")
def _(t: Tables) -> DataFrame:
    said = t.events.select("event_id", F.concat(F.lit("was there from "), F.date_format("ts", "HHmm"), F.lit(" to 2359 hrs, gone at 0615 hrs")).alias("text"))

    @F.pandas_udf("array<struct<position: int, hour: int, minute: int>>")
    def times(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [dict(zip(("position", "hour", "minute"), x, strict=True)) for x in clock_times(s)])

    return said.select("event_id", F.explode(times("text")).alias("t")).select("event_id", "t.*")


@query("sc19_stated_time", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:00') as stated from events")
def _(t: Tables) -> DataFrame:
    said = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("at "), F.date_format("ts", "HHmm"), F.lit(" hrs near the gate, nothing later")).alias("text"))

    @F.pandas_udf("string")
    def stated(texts: pd.Series, days: pd.Series) -> pd.Series:
        return pd.Series([stated_time(s, "gate", d) for s, d in zip(texts, days, strict=True)])

    return said.select("event_id", stated("text", "day").alias("stated"))


@query("da06_device_conflicts")
def _(t: Tables) -> DataFrame:
    """Phones whose spellings fall into two clusters or more; a group is as large as the distinct spellings of one number."""
    spelled = _named(t).select("phone", "name").distinct().withColumn("words", name_words("name"))
    groups = spelled.groupBy("phone").agg(F.sort_array(F.collect_list(F.struct("name", "words"))).alias("names"))
    found = groups.select("phone", name_clusters(F.col("names")).alias("c"))
    return found.select("phone", F.size("c").alias("clusters"), F.array_join(F.transform("c", lambda c: c[0]), " / ").alias("names")).filter("clusters >= 2")


@query("ex16_labelled_lines", r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, regexp_extract(line, '^([A-Z][A-Za-z ]{1,30}): (.+)$', 1) as label, regexp_extract(line, '^([A-Z][A-Za-z ]{1,30}): (.+)$', 2) as value from l where regexp_matches(line, '^([A-Z][A-Za-z ]{1,30}): (.+)$')")
def _(t: Tables) -> DataFrame:
    line = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    p = "^([A-Z][A-Za-z ]{1,30}): (.+)$"
    return line.filter(F.col("line").rlike(p)).select("doc_id", F.regexp_extract("line", p, 1).alias("label"), F.regexp_extract("line", p, 2).alias("value"))


@query("src04_text_source")
def _(t: Tables) -> DataFrame:
    texts = t.documents.filter("source not in ('src1', 'src2')")
    found = e.mentions(texts, "doc_id", "text", {k: e.PATTERNS[k] for k in ("EMAIL", "IPV4", "ACCOUNT")})
    return found.join(texts.select("doc_id", "source"), "doc_id")


@query("tk04_best_paths")
def _(t: Tables) -> DataFrame:
    scored = t.link.withColumn("confidence", F.lit(0.95))
    p = gr.simple_paths(scored, 0, 7, 4, "confidence").withColumn("path", F.array_join("path", "-"))
    return p.orderBy("hops", F.desc("confidence"), "path").limit(6)


@query("snk07_report")
def _(t: Tables) -> DataFrame:
    top = first_of_each(t.flow, ["src"], [F.desc("amount"), F.asc("dst")], 3, "n")
    lines = top.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "dst", "amount"))), lambda r: F.format_string("%d. nation %d: %.2f", r["n"], r["dst"], r["amount"])), "\n").alias("body"))
    return lines.select("src", F.concat(F.format_string("# Nation %d\n\n", "src"), "body").alias("report"))


@query("da26_question")
def _(t: Tables) -> DataFrame:
    return ask.answer(ask.parse("How is NATION_0 connected to NATION_7 within 4 hops?", {"NATION_0": 0, "NATION_7": 7}), t)


@query("da18_investigator_hypothesis")
def _(t: Tables) -> DataFrame:
    from casewright.operators.detectors import hypotheses

    chosen = t.relation.filter("kind = 'OWNS'")
    ref = chosen.filter("candidate_id is not null").select("case_id", F.concat(F.lit("candidate:"), F.col("candidate_id").cast("string")).alias("source_reference")).distinct()
    ev = t.evidence.drop("case_id").join(ref, "source_reference").groupBy("case_id").agg(F.count("*").alias("evidence"), F.count("document_id").alias("documents"))
    rel = chosen.groupBy("case_id").agg(F.count("*").alias("relations"), F.countDistinct("src").alias("entities"), F.lit(0).alias("conflicts"))
    return hypotheses(ev.join(rel, "case_id"))


@query("da27_copilot_answer", "select txn_id, amount, .80::double as confidence, 'txn:' || txn_id as citation from pay where amount >= 90000 and (src_nation = 3 or dst_nation = 3) order by amount desc, txn_id limit 100")
def _(t: Tables) -> DataFrame:
    q = ask.parse("List payments over Rs 0.9 lakh involving NATION_3", {"NATION_3": 3})
    return ask.answer(q, t).select("txn_id", "amount", F.lit(q.confidence).alias("confidence"), F.concat(F.lit("txn:"), F.col("txn_id").cast("string")).alias("citation"))


@query(
    "da29_suggested_questions",
    "with u as (select a as src from link union all select b from link), h as (select src from u group by 1 order by count(*) desc, src limit 1) "
    "(select 1 as place, 'How is nation ' || a || ' connected to nation ' || b || '?' as question from link order by weight desc, a, b limit 1) union all select 2, 'Who is around nation ' || src || '?' from h "
    "union all (select 3, 'Which payments over Rs 1 lakh involve nation ' || src || '?' from flow order by amount desc, src, dst limit 1) union all select 4, 'Who are the key people?' union all select 5, 'Is there any suspicious pattern?'",
)
def _(t: Tables) -> DataFrame:
    return ask.suggested(t)
