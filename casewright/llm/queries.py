"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import bpe, chat, fingerprint, importance, language_id, warc
from casewright.llm.common import SPACE, read, scratch
from casewright.llm.exact_dedup import exact_dedup
from casewright.llm.line_dedup import repeated_runs
from casewright.llm.mixing import mix
from casewright.llm.near_dedup import near_dedup
from casewright.llm.packing import pack
from casewright.llm.passage_dedup import repeated_passages
from casewright.llm.substring_dedup import repeated_stretches, repeated_units
from casewright.llm.whitening import whiten


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_stretches(read(spark, sf_dir, "documents"))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(read(spark, sf_dir, "documents")).drop("row")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprint.with_next(read(spark, sf_dir, "documents"))
    changed = fingerprint.edited(F.col("text"), F.coalesce("next_start", F.lit("")))
    made = both.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode(changed, "utf-8"), 256).alias("edited_sha256"),
        fingerprint.sketch(F.col("text")).alias("own"), fingerprint.sketch(changed).alias("other"), F.col("next_sketch").alias("next"),
    )
    return made.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint.printed(F.col("own")).alias("fingerprint"), fingerprint.printed(F.col("other")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("own"), F.col("other")).alias("near_edited"), fingerprint.resemblance(F.col("own"), F.col("next")).alias("near_next"),
        fingerprint.distinct_shingles(F.col("own")).alias("n_shingles"), fingerprint.containment(F.col("own"), F.col("other")).alias("in_edited"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    found = warc.capture_histories(spark, folder, warc.write_archives(read(spark, sf_dir, "pages"), folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_chats(rows.unionByName(more))
    back = made.withColumn("turns", chat.parse_chats(F.col("formatted"))).withColumn(
        "loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescaped(s["text"])), "")
    )
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    codec = bpe.Codec(spark, vocabulary)
    made = read(spark, sf_dir, "documents").select("doc_id", codec.encode(F.col("text")).alias("ids"))
    back = made.select("doc_id", "ids", codec.decode(F.col("ids")).alias("decoded"))
    return back.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op1_lines, op1_passages, op2_fingerprints, op3_near_dedup, op4_exact_dedup, op5_language_id, op6_line_dedup, op7_warc, op8_best_fit_packing, op9_mixing, op10_chat_format, op11_whitening, op12_importance, op13_bpe)
}

_BLANK = r"[\x20\x09-\x0D]"

ORACLE: dict[str, str] = {
    "op1_lines": rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 unit_no from documents),
placed as (
  select doc_id, unit_no, line, sum(length(line) + 1) over (partition by doc_id order by unit_no) - length(line) - 1 as start from lines),
units as (
  select doc_id, unit_no, start, start + length(line) as stop,
    translate(trim(regexp_replace(line, '{_BLANK}+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as unit from placed),
known as (select * from units where length(unit) - length(replace(unit, ' ', '')) >= 19),
ranked as (
  select *, row_number() over w as n, count(*) over (partition by unit) as group_size, first_value(doc_id) over w as first_id, first_value(unit_no) over w as first_unit
  from known window w as (partition by unit order by doc_id nulls last, unit_no))
select doc_id, cast(unit_no as int) as unit_no, cast(start as bigint) as start, cast(stop as bigint) as stop, md5(unit) as digest, first_id, cast(first_unit as int) as first_unit, group_size
from ranked where n > 1""",
    "op4_exact_dedup": rf"""
with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') as norm from documents),
g as (select *, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by norm) as group_size
  from n window w as (partition by norm order by length(t) desc, doc_id))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from g""",
    "op7_warc": r"""
with p as (select page_id, url, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p),
r as (select *, lower(split_part(regexp_replace(trim(url), '^.*?://', ''), '#', 1)) as rest from f),
h as (select *, regexp_extract(rest, '^[^/?]*') as host, regexp_replace(rest, '^[^/?]*', '') as path from r),
k as (select *, regexp_replace(split_part(host, ':', 1), '^www\.', '') as name, split_part(host, ':', 2) as port from h)
select page_id, strlen(html) as payload_bytes, payload_digest,
  case when strlen(html) >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when strlen(html) >= 100 and page_id > first_id then first_id end as refers_to,
  array_to_string(list_reverse(string_split(name, '.')), ',') || case when port in ('', '80', '443') then '' else ':' || port end || ')'
    || case when path = '' then '/' when path[1] = '/' then path else '/' || path end as url_key,
  1577836800 + page_id as captured
from k""",
    "op9_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 9) as bigint) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size, cast([3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight from d group by source),
c as (select *, 2.0::double * source_size as cap, sum(source_size) over () as everything from s),
w as (
  select *, coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as capped,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as open_weight from c),
l as (select *, (1.5::double * everything - capped) / open_weight as level, row_number() over (order by cap / weight, source nulls last) as place from w),
t as (select source, source_size, least(cap, (select arg_min(level, place) from l where level * weight <= cap) * weight) as target from l),
f as (select *, floor(target / source_size) as copies, target - floor(target / source_size) * source_size as budget from t),
r as (
  select d.*, f.source_size, f.target, f.copies, f.budget,
    sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
    sum(size) over (partition by d.source, h) as own
  from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, target,
  cast(size * (copies + case when copies < 2 and 2 * upto - own <= 2 * budget then 1 else 0 end) as bigint) as taken from r""",
    "op10_chat_format": r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) as n,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    lead(role) over (partition by conv_id order by turn nulls first, role, text) is null as last from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n + 12 + 1 + 11) as bigint) as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end
    and (not last or role = 'assistant')) as valid
from e group by conv_id""",
}
