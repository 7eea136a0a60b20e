"""Tables that change, adapters, registered extractors, terms of a table (WF, SNK, SRC13, EX02, EX06, EX13)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import audit
from casewright.operators import extract as e
from casewright.operators import terms
from casewright.operators import workflow as wf
from casewright.plans.registry import query
from casewright.plans.standin import _FD, _FIRST, _LD, Tables, person_name
from casewright.sources import adapters, extractors, quoted
from casewright.sources.tables import ChangingTable
from casewright.storage import scratch


def _table(t: Tables, tag: str, schema: str, *key: str) -> ChangingTable:
    return ChangingTable(t.spark, scratch(t.spark, tag), schema, list(key))


# --- a queue ---------------------------------------------------------------------------------------------------------
def _none() -> Column:
    return F.lit(None).cast("string")


def _queue(t: Tables) -> ChangingTable:
    jobs = _table(t, "jobs", wf.JOBS, "id")
    jobs.put(t.note.select(F.col("note_id").alias("id"), F.col("note_id").alias("document_id"), F.lit("QUEUED").alias("status"), F.lit(0).alias("attempts"), _none().alias("worker"), _none().alias("error")), "fill")
    return jobs


@query(
    "wf02_claimed_jobs",
    "with q as (select c_custkey as id, row_number() over (order by c_custkey) as n from customer) select id, case when n <= 5 then 'PROCESSING' when n <= 10 then 'QUEUED' when n <= 15 then 'DONE' else 'QUEUED' end as status, "
    "case when n <= 15 then 1 else 0 end as attempts, case when n <= 5 then 'a' when n <= 10 then null when n <= 15 then 'c' end as worker from q",
)
def _(t: Tables) -> DataFrame:
    """Three workers claim five jobs each; the second one's are given up, the third one's end; no job is in two hands."""
    jobs = _queue(t)
    wf.claim(jobs, "a")
    wf.claim(jobs, "b")
    wf.settle(jobs, wf.claim(jobs, "c"), _none(), "end-c")
    wf.requeue(jobs, (F.col("worker") == "b") & (F.col("status") == "PROCESSING"), "stuck-b")
    return jobs.read().select("id", "status", "attempts", "worker")


_RULES = [("phone", r"\b(9\d{9})\b", 1, 0.95), ("vehicle", r"\b([A-Z]{2}\d{1,2}[A-Z]{1,2}\d{3,4})\b", 1, 0.95), ("location", r"\b(Harbour Road)\b", 1, 0.80)]


def _extract(notes: DataFrame) -> DataFrame:
    found = e.rule_entities(notes, "note_id", "text", _RULES)
    return found.select(F.col("note_id").alias("document_id"), (F.col("note_id") % 5).alias("case_id"), F.col("kind").alias("entity_type"), F.col("value").alias("name"), F.lit("text").alias("place"), "confidence")


_FOUND = " union all ".join(f"select note_id as document_id, note_id % 5 as case_id, '{k}' as entity_type, trim(unnest(regexp_extract_all(text, '{p}', {g}))) as name, {c}::double as confidence from note" for k, p, g, c in _RULES)
_CANDIDATES = f"fo as ({_FOUND}), ca as (select row_number() over (order by document_id, entity_type, name) as id, document_id, case_id, entity_type, name, max(confidence) as confidence from fo group by document_id, case_id, entity_type, name)"


def _persisted(t: Tables) -> ChangingTable:
    candidates = _table(t, "candidates", wf.CANDIDATES, "id")
    for batch in ("run 1", "run 1", "run 2"):  # a batch that comes again, and another run over the same documents
        wf.persist_extraction(candidates, _extract(t.note), batch)
    return candidates


@query("snk09_persisted_candidates", f"with {_CANDIDATES} select id, document_id, entity_type, name, confidence, 'PENDING' as status from ca")
def _(t: Tables) -> DataFrame:
    return _persisted(t).read().select("id", "document_id", "entity_type", "name", "confidence", "status")


_ACCEPTED = _CANDIDATES + (
    ", ac as (select *, lower(name) as key from ca where document_id % 3 = 0), en as (select min(id) as first_id, case_id, entity_type, key from ac group by 2, 3, 4), "
    "ei as (select row_number() over (order by first_id) as entity_id, * from en)"
)


def _accepted(t: Tables) -> dict[str, ChangingTable]:
    made = {"candidates": _persisted(t), "entities": _table(t, "entities", wf.ENTITIES, "id"), "evidence": _table(t, "evidence", wf.EVIDENCE, "reference")}
    for batch in ("accept", "accept"):
        wf.accept(made["candidates"], made["entities"], made["evidence"], made["candidates"].read().filter("document_id % 3 = 0"), batch)
    return made


@query("wf04_accepted_candidates", f"with {_ACCEPTED} select ca.id, case when ei.entity_id is null then 'PENDING' else 'ACCEPTED' end as status, ei.entity_id from ca left join ac on ac.id = ca.id left join ei on ei.case_id = ac.case_id and ei.entity_type = ac.entity_type and ei.key = ac.key")
def _(t: Tables) -> DataFrame:
    return _accepted(t)["candidates"].read().select("id", "status", "entity_id")


@query("wf04_accepted_evidence", f"with {_ACCEPTED} select 'candidate:' || id as reference, document_id, name || ' (' || entity_type || ')' as description, confidence from ac")
def _(t: Tables) -> DataFrame:
    return _accepted(t)["evidence"].read().select("reference", "document_id", "description", "confidence")


@query("snk11_stored_snapshots", "select case_id, n as sequence, section, id from (select case_id, 'entities' as section, id from entity union all select case_id, 'relations', id from relation) cross join (select unnest([1, 2]) as n)")
def _(t: Tables) -> DataFrame:
    """Two snapshots of all cases; the first one's batch comes twice."""
    kept = _table(t, "snapshots", wf.SNAPSHOTS, "case_id", "sequence", "section", "id")
    for batch in ("first", "first", "second"):
        wf.snapshot(kept, {"entities": t.entity, "relations": t.relation}, t.entity, batch)
    return kept.read().select("case_id", "sequence", "section", "id")


@query(
    "snk12_run_versions",
    "with a as (select case_id, 1 as run, count(*) as findings, md5(string_agg(id || ':' || kind, ',' order by id)) as version from relation group by 1), "
    "b as (select case_id, count(*) as findings, md5(string_agg(id || ':' || kind, ',' order by id)) as version from relation where case_id <> 2 or id % 2 = 0 group by 1) "
    "select case_id, run, findings, version, null::bigint as supersedes from a union all select b.case_id, 2, b.findings, b.version, 1 from b join a using (case_id) where a.version <> b.version",
)
def _(t: Tables) -> DataFrame:
    """Run records of all cases, and again after one has changed: only that one has a second run, which supersedes the first."""
    runs = _table(t, "runs", wf.RUNS, "case_id", "run")

    def measured(rows: DataFrame) -> DataFrame:
        # a case's rows in order, in one text
        line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "kind"))), lambda s: F.concat_ws(":", s["id"].cast("string"), s["kind"])), ",")
        return rows.groupBy("case_id").agg(F.count("*").alias("findings"), F.md5(line).alias("version"))

    wf.record_run(runs, measured(t.relation), "first")
    wf.record_run(runs, measured(t.relation.filter("case_id != 2 or id % 2 = 0")), "second")
    return runs.read().select("case_id", "run", "findings", "version", "supersedes")


@query(
    "wf11_job_states",
    f"with {_CANDIDATES} select c_custkey as document_id, case when c_custkey % 11 = 0 then 'FAILED' else 'DONE' end as status, case when c_custkey % 11 = 0 then 'no text' end as error, count(ca.id) as candidates from customer left join ca on ca.document_id = c_custkey and c_custkey % 11 <> 0 group by 1, 2, 3",
)
def _(t: Tables) -> DataFrame:
    """A job for each note, worked off in two claims: extraction, candidates, end; notes without a text fail."""
    jobs, candidates = _queue(t), _table(t, "candidates", wf.CANDIDATES, "id")
    notes = t.note.withColumn("text", F.when(F.col("note_id") % 11 != 0, F.col("text")))
    half = (notes.count() + 1) // 2
    for worker in ("a", "b"):
        wf.process(jobs, candidates, worker, notes, "note_id", "text", _extract, half)
    n = candidates.read().groupBy("document_id").agg(F.count("*").alias("candidates"))
    return jobs.read().join(n, "document_id", "left").select("document_id", "status", "error", F.coalesce("candidates", F.lit(0)).alias("candidates"))


# --- adapters and extractors -----------------------------------------------------------------------------------------
@query("src13_adapter_source", "select s_suppkey::varchar as subject, s_name as label, s_nationkey::varchar as unit from supplier where s_nationkey in (3, 5, 7, 11)")
def _(t: Tables) -> DataFrame:
    """Another office's records, read with an authorisation and filtered by the reader; without one there are none."""
    adapters.register(t.spark)
    path = scratch(t.spark, "office")
    t.supplier.select(F.col("s_suppkey").alias("accused_id"), F.col("s_name").alias("full_name"), F.col("s_nationkey").alias("ps")).write.json(path)
    source = lambda: t.spark.read.format("casewright_adapter").options(fixture=path, fields='{"subject": "accused_id", "label": "full_name", "unit": "ps"}')
    few = source().option("authorisation", "order 12").load().filter(F.col("unit").isin("3", "5", "7", "11"))
    return few.unionByName(source().load())


@query(
    "ex06_registered_extractors",
    r"select note_id, value, case when note_id % 7 = 0 then 'fallback' else 'first' end as extractor from (select note_id, unnest(regexp_extract_all(text, '9\d{9}')) as value from note where note_id % 7 <> 0 union all select note_id, unnest(regexp_extract_all(text, '[A-Z]{2}\d{2}[A-Z]{2}\d{4}')) from note where note_id % 7 = 0)",
)
def _(t: Tables) -> DataFrame:
    """A table function by name for phones; where it fails, a second one for vehicles."""

    def phones(text: str):
        if text.startswith("0"):
            raise LookupError("no model for this text")
        return [(m,) for m in re.findall(r"9\d{9}", text)]

    extractors.register(t.spark, "casewright_phones", phones, "value string", lambda text: [(m,) for m in re.findall(r"[A-Z]{2}\d{2}[A-Z]{2}\d{4}", text)])
    t.note.withColumn("text", F.when(F.col("note_id") % 7 == 0, F.concat(F.lit("0 "), "text")).otherwise(F.col("text"))).createOrReplaceTempView("casewright_notes")
    return t.spark.sql("select n.note_id, m.value, m.extractor from casewright_notes n, lateral casewright_phones(n.text) m")


# --- terms -----------------------------------------------------------------------------------------------------------
_TERMS = f"tm as (select distinct {person_name('c_custkey')} as term, 'PERSON' as kind, .93 as confidence from customer union all select 'Harbour Road', 'LOCATION', .90 union all select 'Acme Traders', 'ORG', .95 union all select 'विकरम सठ', 'PERSON', .93)"


@query(
    "ex02_term_mentions",
    f"with {_TERMS}, p as (select note_id, term, kind, confidence, string_split(text, term) as s from note join tm on contains(text, term)), q as (select *, unnest(range(1, len(s))) as k from p) "
    "select note_id, term, kind, confidence::double as confidence, cast(list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * length(term) as int) as start from q",
)
def _(t: Tables) -> DataFrame:
    """Every occurrence of the names of all people, of a place, an organisation and a name in Devanagari, with its offset."""
    names = t.customer.select(F.expr(person_name("c_custkey")).alias("term"), F.lit("PERSON").alias("kind"), F.lit(0.93).alias("confidence")).distinct()
    more = [("Harbour Road", "LOCATION", 0.90), ("Acme Traders", "ORG", 0.95), ("विकरम सठ", "PERSON", 0.93)]
    return terms.term_mentions(t.note, "note_id", "text", names.union(t.spark.createDataFrame(more, names.schema))).select("note_id", "term", "kind", "confidence", "start")


_PLACE = "case when c_custkey % 2 = 0 then 'दादर' else 'ठाणे' end"
_SAID = f"case c_custkey % 5 when 0 then {_FD} || ' ' || {_LD} || ' को ' || {_PLACE} || ' में देखा 2024-01-02 10:30' when 1 then {_FD} || ' ' || {_LD} || ' को बहुत दिनों के बाद फिर एक बार शाम के समय ' || {_PLACE} || ' में देखा 2024-01-02 10:30' when 2 then {_PLACE} || ' में ' || {_FD} || ' ' || {_LD} || ' 2024-01-02 10:30' when 3 then {_FD} || ' ' || {_LD} || ' को ' || {_PLACE} || ' में देखा' else {_FD} || ' ' || {_LD} || ' और ' || {_PLACE} || ' 2024-01-02 10:30' end"


@query("ex13_multilingual_claims", f"select c_custkey as id, 'N' || ({_FIRST}) || '-' || (c_custkey % 7) as subject, case when c_custkey % 2 = 0 then 'Dadar' else 'Thane' end as object, '2024-01-02 10:30' as stamp from customer where c_custkey % 5 = 0".replace("cast(floor(c_custkey / 7) as bigint)", "(c_custkey // 7)"))
def _(t: Tables) -> DataFrame:
    """A person and, soon after, a place, in lines with a connective and a stamp; far apart, turned round, without one or the other they say nothing."""
    lines = t.customer.select(F.col("c_custkey").alias("id"), F.lit("hi").alias("lang"), F.expr(_SAID).alias("text"))
    people = t.customer.select(F.concat(F.expr(_FD), F.lit(" "), F.expr(_LD)).alias("term"), F.lit("hi").alias("lang"), F.lit("person").alias("kind"), F.concat(F.lit("N"), F.expr(_FIRST).cast("string"), F.lit("-"), (F.col("c_custkey") % 7).cast("string")).alias("name")).distinct()
    places = t.spark.createDataFrame([("दादर", "hi", "location", "Dadar"), ("ठाणे", "hi", "location", "Thane")], people.schema)
    linked = t.spark.createDataFrame([("में", "hi")], "word string, lang string")
    return terms.multilingual_claims(lines, "id", "text", people.union(places), linked, r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}").select("id", "subject", "object", "stamp")


# --- audit -----------------------------------------------------------------------------------------------------------
@query(
    "wf09_chain_breaks",
    "with n as (select *, row_number() over (partition by user_id order by us, event_id) as seq from ev), k as (select * from n where event_id % 101 <> 0), m as (select *, lag(seq) over (partition by user_id order by seq) as before from k), "
    "b as (select user_id, seq, case when coalesce(before, 0) <> seq - 1 then 'previous' when event_id % 97 = 0 then 'entry' end as reason from m), f as (select user_id, min(seq) as first_break, arg_min(reason, seq) as reason from b where reason is not null group by 1) "
    "select user_id::varchar as chain, count(*) as entries, f.first_break is null as intact, first_break, f.reason from k left join f using (user_id) group by 1, 4, 5",
)
def _(t: Tables) -> DataFrame:
    """A chain for each user's events, of which some entries are altered and some taken out: where each breaks first."""
    said = F.concat_ws(" ", "event_id", "event_type")
    rows = t.ev.select("user_id", "us", "event_id", said.alias("said"))
    made = audit.appended(rows, "user_id", ["us", "event_id"], "said").withColumn("_id", F.split_part("said", F.lit(" "), F.lit(1)).cast("long"))
    spoilt = made.filter("_id % 101 != 0").withColumn("said", F.when(F.col("_id") % 97 == 0, "another thing").otherwise(F.col("said"))).drop("_id")
    return audit.verified(spoilt)


# --- documents with quotes -------------------------------------------------------------------------------------------
@query("src11_quoted_documents", "select c_custkey as id, 1 as row_no, case when c_custkey % 9 <> 0 then c_name || ', ' || chr(10) || c_mktsegment end as who, case when c_custkey % 9 = 0 then 'not valid UTF-8' end as problem from customer where c_custkey % 9 <> 0 union all select c_custkey, 0, null, case when c_custkey % 9 = 0 then 'not valid UTF-8' end from customer")
def _(t: Tables) -> DataFrame:
    """A CSV document for each customer, with a mark, a comma and a line end in a quoted cell; some are no UTF-8."""
    text = F.concat(F.lit("﻿who,key\r\n\""), "c_name", F.lit(", \n"), "c_mktsegment", F.lit("\","), F.col("c_custkey").cast("string"), F.lit("\r\n"))
    content = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.encode(text, "utf-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(text, "utf-8"))
    found = quoted.csv_documents(t.customer.select(F.col("c_custkey").alias("id"), content.alias("content")), "id", "content")
    return found.select("id", "row_no", F.element_at("cells", "who").alias("who"), "problem")


@query("snk03_cleared_sources", "select 'entity' as source, count(*) as before, 0::bigint as after, count(*) filter (case_id = 1) as again from entity union all select 'relation', count(*), 0, count(*) filter (case_id = 1) from relation")
def _(t: Tables) -> DataFrame:
    """Rows of two sources before they are cleared, after, and after one case has been put again."""
    out = None
    for name, rows in (("entity", t.entity.select("id", "case_id")), ("relation", t.relation.select("id", "case_id"))):
        table = _table(t, name, "id long, case_id long", "id")
        numbers = [table.put(rows, "all"), wf.clear(table, "clear"), table.put(rows.filter("case_id = 1"), "again")]
        counts = [table.read(n).agg(F.count("*").alias(c)) for n, c in zip(numbers, ("before", "after", "again"), strict=True)]
        one = counts[0].join(counts[1]).join(counts[2]).select(F.lit(name).alias("source"), "before", "after", "again")  # one row each
        out = one if out is None else out.unionByName(one)
    return out
