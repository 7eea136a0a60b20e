"""Sources, sinks and extraction over whole tables (SRC, SNK, EX)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import any_timestamp
from casewright.operators import extract as e
from casewright.plans.registry import query
from casewright.plans.standin import Tables
from casewright.sources import feeds, sinks
from casewright.storage import scratch


@query("src01_csv_feed", "select c_custkey, c_name, c_acctbal from customer")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return feeds.csv_feed(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("src02_json_feed", "select s_suppkey, s_name from supplier")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "json")
    t.supplier.select("s_suppkey", "s_name").write.json(path)
    return t.spark.read.schema("s_suppkey long, s_name string").json(path)


@query("src03_optional_source", "select s_suppkey as id, s_name as name from supplier")
def _(t: Tables) -> DataFrame:
    extra = feeds.optional_feed(t.spark, scratch(t.spark, "absent"), "id long, name string")
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(extra)


@query("src06_calls_without_excluded", "select call_id from call where call_id not in (select event_id from ev where event_type = 'error' and value > 100)")
def _(t: Tables) -> DataFrame:
    excluded = t.ev.filter("event_type = 'error' and value > 100").select(F.col("event_id").alias("call_id"))
    return feeds.without(t.call, "call_id", excluded).select("call_id")


@query("src07_payment_parties", "select txn_id, case when dst in (select s_suppkey from supplier where s_acctbal > 0) then 'ORG' else 'PERSON' end as party_kind from pay")
def _(t: Tables) -> DataFrame:
    return feeds.split_parties(t.pay, "dst", t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))).select("txn_id", "party_kind")


@query("src08_typed_records", "select id, name, cast(prior_cases as int) as prior from person")
def _(t: Tables) -> DataFrame:
    return t.person.select("id", "name", F.col("prior_cases").cast("int").alias("prior"))


@query("src10_text_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents) select doc_id, line_no::int as line_no, line from l")
def _(t: Tables) -> DataFrame:
    return feeds.text_lines(t.documents, "doc_id", "text")


@query("src11_csv_documents", "select n_nationkey as id, 1 as row_no, n_name as first_cell from nation")
def _(t: Tables) -> DataFrame:
    texts = t.nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("name,region\n"), "n_name", F.lit(", "), F.col("n_regionkey").cast("string")).alias("text"))
    return feeds.csv_document(texts, "id", "text").select("id", "row_no", F.get("cells", 0).alias("first_cell"))


@query("src13_adapter", "select s_suppkey as subject, s_name as label from supplier")
def _(t: Tables) -> DataFrame:
    return feeds.adapter(t.supplier, {"subject": "s_suppkey", "label": "s_name"}, "warrant").unionByName(feeds.adapter(t.supplier, {"subject": "s_suppkey", "label": "s_name"}, None))


@query("src14_upload_validation", "select doc_id, case when doc_id % 5 = 0 then 'extension' when strlen(text) > 4000 then 'size' when doc_id % 5 = 1 then 'magic bytes' end as reason from documents")
def _(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in ("exe", "pdf", "txt", "csv", "txt")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", feeds.upload_verdict(F.concat_ws(".", F.lit("f"), ext), F.encode("text", "utf-8"), 4000).alias("reason"))


@query("src15_upload_dedupe", "select min(doc_id) as doc_id, source from documents group by source, sha256(text)")
def _(t: Tables) -> DataFrame:
    return feeds.first_by_hash(t.documents, "source", "text", "doc_id").select("doc_id", "source")


@query("src17_case_bundle", "select case_id, count(*) as rows_in from (select case_id from entity union all select case_id from relation union all select case_id from evidence) where case_id = 2 group by 1")
def _(t: Tables) -> DataFrame:
    parts = [df.filter("case_id = 2").select("case_id") for df in (t.entity, t.relation, t.evidence)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("case_id").agg(F.count("*").alias("rows_in"))


@query("src18_evidence_index", "select source_reference, count(*) as n, min(id) as first_id from evidence group by 1")
def _(t: Tables) -> DataFrame:
    return t.evidence.groupBy("source_reference").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("src19_accepted_candidates", "select src, count(*) as candidates from relation where candidate_id is not null group by 1")
def _(t: Tables) -> DataFrame:
    return t.relation.filter("candidate_id is not null").groupBy("src").agg(F.count("*").alias("candidates"))


@query("snk01_append_without_repeats", "select p_partkey as id, p_name as name from part")
def _(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(1).alias("seq"))
    old = rows.filter("id % 3 = 0")
    return sinks.appended(old, rows.unionByName(rows.withColumns({"seq": F.lit(2), "name": F.lit("late")})), "id", "seq").select("id", "name")


@query("snk02_next_id", "select 'C' || lpad((max(c_custkey) + 1)::varchar, 6, '0') as next_id from customer")
def _(t: Tables) -> DataFrame:
    return sinks.next_id(t.customer.select(F.format_string("C%06d", "c_custkey").alias("id")), "id")


@query("snk03_cleared", "select id, name from entity where false")
def _(t: Tables) -> DataFrame:
    return t.entity.select("id", "name").limit(0)


@query("snk04_cypher", "select 'MERGE (n:' || entity_type || ' {id: ''' || id || '''}) SET n.label = ''' || name || ''';' as line from entity union all select 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[:' || kind || ']->(b);' from relation")
def _(t: Tables) -> DataFrame:
    return sinks.cypher(t.entity.select("id", F.col("entity_type").alias("kind"), F.col("name").alias("label")), t.relation.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind"))


@query("snk05_json", "select '{\"id\":' || id || ',\"name\":\"' || name || '\"}' as line from entity")
def _(t: Tables) -> DataFrame:
    return sinks.json_lines(t.entity.select("id", "name"))


@query("snk06_export_pump", "with k as (select least(src, dst) as a, greatest(src, dst) as b, kind, id from relation where src <> dst), r as (select *, row_number() over (partition by a, b order by id) as n from k) select a, b, max(kind) filter (n = 1) as rel, string_agg(id::varchar, ' | ' order by id) filter (n <= 3) as evidence from r group by 1, 2")
def _(t: Tables) -> DataFrame:
    from casewright.operators.aggregates import merged_edges

    o = t.relation.select("src", "dst", F.col("kind").alias("type"), F.lit(1.0).alias("weight"), "confidence", F.lit(None).cast("timestamp").alias("ts"), F.col("id").cast("string").alias("source"), F.col("id").alias("seq"))
    return sinks.exported_edges(merged_edges(o))


@query("snk09_idempotent_persist", "select id, name from entity")
def _(t: Tables) -> DataFrame:
    rows = t.entity.select("id", "name", F.lit(1).alias("seq"))
    once = sinks.appended(rows.limit(0), rows, "id", "seq")
    return sinks.appended(once, rows, "id", "seq").select("id", "name")


@query("snk10_versioned_findings", "select id, case when id % 3 = 0 then false else true end as stale from relation")
def _(t: Tables) -> DataFrame:
    f = t.relation.select("id", F.when(F.col("id") % 3 == 0, "v2").otherwise("v1").alias("graph_version"))
    return sinks.marked_stale(f, "v2").select("id", "stale")


@query("snk11_snapshot", "select c.case_id, coalesce(max(r.case_id) * 0 + 3, 0) + 1 as sequence from (select distinct case_id from entity) c left join relation r on r.case_id = c.case_id and r.case_id < 3 group by 1")
def _(t: Tables) -> DataFrame:
    before = t.relation.filter("case_id < 3").select("case_id", F.lit(3).alias("sequence"))
    return sinks.snapshot(t.entity.select("case_id").distinct(), before, "case_id").select("case_id", F.col("sequence").cast("long").alias("sequence"))


@query("snk12_run_records", "select case_id, count(*) as findings from relation group by 1")
def _(t: Tables) -> DataFrame:
    return t.relation.groupBy("case_id").agg(F.count("*").alias("findings"))


@query("snk13_seeded_rows", "select id as node, entity_type as kind, 'seed:' || id as reference from entity")
def _(t: Tables) -> DataFrame:
    return t.entity.select(F.col("id").alias("node"), F.col("entity_type").alias("kind"), F.concat(F.lit("seed:"), F.col("id").cast("string")).alias("reference"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("ex01_regex_mentions", rf"select doc_id, 'EMAIL' as kind, unnest(regexp_extract_all(text, '{_EMAIL}')) as value from documents union all select doc_id, 'VEHICLE', unnest(regexp_extract_all(text, '[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{1,2}}[0-9]{{4}}')) from documents union all select doc_id, 'HEX', unnest(regexp_extract_all(text, '[0-9a-f]{{40}}')) from documents")
def _(t: Tables) -> DataFrame:
    return e.mentions(t.documents, "doc_id", "text", {"EMAIL": e.PATTERNS["EMAIL"], "VEHICLE": e.PATTERNS["VEHICLE"], "HEX": "[0-9a-f]{40}"})


@query("ex02_gazetteer_mentions", "select doc_id, term from documents cross join (select unnest(['License', 'The', 'Von', 'Los', 'Le']) as term) where contains(text, term)")
def _(t: Tables) -> DataFrame:
    return e.gazetteer(t.documents, "doc_id", "text", ["License", "The", "Von", "Los", "Le"])


@query("ex17_match_or_create", "select k.name, min(k.id) as id, least(95, 45 + 12 * count(*)) as strength from (select lower(name) as name, id from entity) k group by 1")
def _(t: Tables) -> DataFrame:
    return t.entity.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"), F.least(F.lit(95), 45 + 12 * F.count("*")).alias("strength"))


@query("src16_object_store", "select s_suppkey, s_name from supplier")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "objects")  # any store that Hadoop knows
    t.supplier.select("s_suppkey", "s_name").write.parquet(path)
    return t.spark.read.parquet(path)


@query("src20_fuzzy_rows", "select c_custkey::varchar as id, c_name as label from customer")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "tsv")
    t.customer.select(F.col("c_custkey").alias("Customer ID"), F.col("c_name").alias("Full Name")).write.option("header", True).option("sep", "\t").csv(path)
    return feeds.fuzzy_rows(t.spark, path, {"id": "id", "label": "name"})
