"""Scalar functions over whole tables (SC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from casewright.functions import measures as m
from casewright.functions import text as x
from casewright.operators import names
from casewright.plans.registry import query
from casewright.plans.standin import Tables

_WORDS = {"en": ["the", "and", "of", "with"], "fr": ["le", "et", "des", "dans"], "de": ["der", "und", "die", "nicht"], "es": ["el", "los", "que", "para"]}


@query("sc01_normalize_digits", "select doc_id, translate(translate(text, '0123456789', '०१२३४५६७८९'), '०१२३४५६७८९', '0123456789') as t from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.normalize_digits(F.translate("text", "0123456789", x.DEVANAGARI_DIGITS)).alias("t"))


@query("sc02_script_test", "select doc_id, regexp_matches(translate(text, '7', '७'), '[ऀ-ॿ]') as deva from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.has_devanagari(F.translate("text", "7", "७")).alias("deva"))


_SKELETON = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"
_HEAD = "translate(replace(" + _SKELETON + ", 'ph', 'f'), 'qzwx', 'kjvk')"


def _skeleton_sql(c: str) -> str:
    u = _HEAD.format(c)
    out = f"substr({u}, 1, 1) || regexp_replace(substr({u}, 2), '[aeiouy]', '', 'g')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{letter}{letter}+', '{letter}', 'g')"
    return out


@query("sc05_skeleton", f"select p_partkey, {_skeleton_sql('p_name')} as sk from part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", x.skeleton(F.col("p_name")).alias("sk"))


@query(
    "sc06_name_key",
    f"with w as (select p_partkey, unnest(regexp_split_to_array(p_name, '[\\s.]+')) as w from part), s as (select p_partkey, {_skeleton_sql('w')} as sk from w) select p_partkey, coalesce(string_agg(sk, ' ' order by sk) filter (sk <> ''), '') as k from s group by 1",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", x.name_key(F.col("p_name")).alias("k"))


@query("sc08_normalize_for_match", r"select c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'), 'a{2,}', 'a', 'g'), 'e{2,}', 'e', 'g'), 'o{2,}', 'o', 'g'), '\s+', ' ', 'g')) as k from customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", x.normalize_for_match(F.col("c_name")).alias("k"))


@query("sc09_normalize_name", r"select id, regexp_replace(trim(lower(name)), '\s+', ' ', 'g') as k from entity")
def _(t: Tables) -> DataFrame:
    return t.entity.select("id", x.normalize_name(F.col("name")).alias("k"))


@query("sc10_norm_tokens", r"select p_partkey, array_to_string(list_filter(list_transform(string_split(lower(p_name), ' '), lambda w : case w when 'small' then 'sm' when 'large' then 'lg' else w end), lambda w : w not in ('part', '')), ' ') as k from part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(x.norm_tokens(F.col("p_name"), {"small": "sm", "large": "lg"}, ["part"]), " ").alias("k"))


@query("sc14_haversine_corpus", "select p.id as a, q.id as b, 2 * 6371.0 * asin(sqrt((pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) as km from place p join place q on p.id < q.id")
def _(t: Tables) -> DataFrame:
    return _km(t, m.config.RADIUS_CORPUS)


@query("sc15_haversine_case", "select p.id as a, q.id as b, 2 * 6371.0088 * asin(sqrt((pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) as km from place p join place q on p.id < q.id")
def _(t: Tables) -> DataFrame:
    return _km(t, m.config.RADIUS_CASE)


def _km(t: Tables, radius: float) -> DataFrame:
    p, q = t.place.alias("p"), t.place.alias("q")
    return p.join(q, F.expr("p.id < q.id")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), m.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon"), radius).alias("km"))


@query("sc16_minutes_between", "select call_id, abs(us - lag(us) over (partition by tower order by us, call_id)) / 6e7 as minutes from call")
def _(t: Tables) -> DataFrame:
    before = F.lag("us").over(_by(["tower"], "us", "call_id"))
    return t.call.select("call_id", m.minutes_between(F.col("us"), before).alias("minutes"))


def _by(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


@query("sc17_week_start", "select event_id, cast(date_trunc('week', ts) as date) as week from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_trunc("week", "ts").cast("date").alias("week"))


@query(
    "sc20_multi_format_timestamp",
    "select o_orderkey, cast(date_trunc('day', o_orderdate) as timestamp) as ts from orders",
)
def _(t: Tables) -> DataFrame:
    shapes = ["yyyy-MM-dd", "dd/MM/yyyy", "dd MMM yyyy", "yyyy/MM/dd"]
    said = F.element_at(F.array(*[F.date_format("o_orderdate", s) for s in shapes]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", x.any_timestamp(said, shapes).cast("timestamp_ntz").alias("ts"))


@query("sc22_year_ranges_overlap", "select o_custkey, max(year(o_orderdate)) <= min(year(o_orderdate) + o_orderkey % 3) as overlap from orders group by 1")
def _(t: Tables) -> DataFrame:
    lo = F.year("o_orderdate")
    spans = t.orders.withColumn("span", F.concat_ws("-", lo.cast("string"), (lo + F.col("o_orderkey") % 3).cast("string")))
    return spans.groupBy("o_custkey").agg(x.ranges_overlap(F.col("span")).alias("overlap"))


def _language_sql() -> str:
    hits = {k: f"len(list_intersect(w, {v!r}))" for k, v in _WORDS.items()}
    most = f"greatest({', '.join(hits.values())})"
    return (
        "with t as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as w from documents) select doc_id, case "
        + f"when {most} = 0 then null "
        + " ".join(f"when {h} = {most} then '{k}'" for k, h in hits.items())
        + " end as lang from t"
    )


@query("sc23_language_census", _language_sql())
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.language(F.col("text"), _WORDS).alias("lang"))


@query("sc24_question_language", "select conv_id, turn, case when regexp_matches(text, '[ऀ-ॿ]') then 'hi' when regexp_matches(text, '[؀-ۿ]') then 'ur' else 'en' end as lang from conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.when(x.has_devanagari(F.col("text")), "hi").when(F.col("text").rlike("[؀-ۿ]"), "ur").otherwise("en").alias("lang"))


@query("sc25_letter_share", r"select doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / cast(nullif(length(text), 0) as double) as latin from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.nullif(F.length("text"), F.lit(0))).alias("latin"))


@query(
    "sc26_context",
    "with p as (select doc_id, text, instr(text, 'in') - 1 as s, instr(text, 'in') + 1 as e from documents where instr(text, 'in') > 0) select doc_id, (case when s > 90 then '…' else '' end) || trim(substr(text, cast(greatest(s - 90, 0) + 1 as bigint), cast(least(e + 90, length(text)) - greatest(s - 90, 0) as bigint)), ' ') || (case when e + 90 < length(text) then '…' else '' end) as c from p",
)
def _(t: Tables) -> DataFrame:
    at = F.instr("text", "in")
    return t.documents.filter(at > 0).select("doc_id", x.context(F.col("text"), at - 1, at + 1).alias("c"))


@query("sc27_snippet", r"select doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 240) as s from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.snippet(F.col("text")).alias("s"))


@query("sc28_amount", "select o_orderkey, cast(floor(o_totalprice) as bigint) * (case o_orderkey % 4 when 0 then 1e7 when 1 then 1e5 when 2 then 1e3 else 1.0 end) as amount from orders")
def _(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in (" crore", " lakh", "k", " rupees")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", x.amount(F.concat(F.lit("paid "), F.format_number(F.floor("o_totalprice"), 0), unit)).alias("amount"))


@query("sc29_match_relevance", "select c_custkey, case when lower(c_mktsegment) = 'building' then 1.0 when starts_with(lower(c_mktsegment), 'building') then 0.9 when contains(lower(c_mktsegment), 'building') then 0.75 else 0.0 end::double as r from customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", x.match_score(F.col("c_mktsegment"), "building").alias("r"))


@query("sc31_identifiers", r"select c_custkey, right(regexp_replace(c_name || '-98765-43210', '[^0-9]', '', 'g'), 10) as phone, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') as vehicle from customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", x.phone(F.concat("c_name", F.lit("-98765-43210"))).alias("phone"), x.vehicle(F.col("c_name")).alias("vehicle"))


@query("sc32_event_type", "select event_id, case when regexp_matches(event_type, '(?i)click|view') then 'browse' when regexp_matches(event_type, '(?i)error|fail') then 'incident' when regexp_matches(event_type, '(?i)buy|purchase|order') then 'purchase' else 'other' end as kind from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", x.by_keyword(F.col("event_type"), [("browse", "click|view"), ("incident", "error|fail"), ("purchase", "buy|purchase|order")], "other").alias("kind"))


@query("sc33_place_type", "select n_nationkey, case when regexp_matches(n_name, '(?i)1|5') then 'market' when regexp_matches(n_name, '(?i)2|7') then 'station' else 'area' end as kind from nation")
def _(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", x.by_keyword(F.col("n_name"), [("market", "1|5"), ("station", "2|7")], "area").alias("kind"))


@query("sc34_record_weight", "select event_id, (case event_type when 'click' then 0.9 when 'view' then 0.5 else 0.6 end) * least(greatest(value / 100, 0.0), 1.0) / sqrt(row_number() over (partition by user_id, event_type order by us, event_id)) as w from ev")
def _(t: Tables) -> DataFrame:
    k = F.row_number().over(_by(["user_id", "event_type"], "us", "event_id"))
    known = F.when(F.col("event_type") == "click", 0.9).when(F.col("event_type") == "view", 0.5)
    return t.ev.select("event_id", m.record_weight(known, F.col("value") / 100, k).alias("w"))


@query("sc35_assess", "with s as (select user_id, sum(case when k % 2 = 0 then value else 0 end) as sup, sum(case when k % 2 = 1 then value else 0 end) as con from ev group by 1), r as (select *, case when sup + con > 0 then con / (sup + con) else 0.0 end as ratio from s) select user_id, ratio, 0.85 * (1 - 0.45 * ratio) as adjusted, case when ratio >= .5 then 'high' when ratio >= .25 then 'medium' else 'low' end as severity from r")
def _(t: Tables) -> DataFrame:
    side = lambda k: F.sum(F.when(F.col("k") % 2 == k, F.col("value")).otherwise(0.0))
    s = t.ev.groupBy("user_id").agg(side(0).alias("sup"), side(1).alias("con")).withColumn("ratio", m.contra_ratio(F.col("sup"), F.col("con")))
    return s.select("user_id", "ratio", m.adjusted(F.lit(0.85), F.col("ratio")).alias("adjusted"), m.severity(F.col("ratio")).alias("severity"))


@query("sc36_version_hash", "with l as (select case_id, 0 as o, id, 'e' || id || '|' || entity_type || '|' || lower(name) || chr(10) as line from entity union all select case_id, 1, id, 'r' || id || '|' || kind || '|' || src || '|' || dst || chr(10) from relation) select case_id, left(sha256(string_agg(line, '' order by o, id)), 16) as version from l group by 1")
def _(t: Tables) -> DataFrame:
    e = t.entity.select("case_id", F.lit(0).alias("o"), "id", F.concat(F.lit("e"), F.concat_ws("|", F.col("id").cast("string"), "entity_type", x.normalize_name(F.col("name"))), F.lit("\n")).alias("line"))
    r = t.relation.select("case_id", F.lit(1).alias("o"), "id", F.concat(F.lit("r"), F.concat_ws("|", F.col("id").cast("string"), "kind", F.col("src").cast("string"), F.col("dst").cast("string")), F.lit("\n")).alias("line"))
    return x.version_hash(e.unionByName(r), "case_id")


@query("sc37_org_id", "select s_suppkey, 'O-' || left(sha1(s_name), 8) as id from supplier")
def _(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", x.org_id(F.col("s_name")).alias("id"))


@query("sc38_org_or_person", r"select c_custkey, regexp_matches(case when c_custkey % 2 = 0 then c_name || ' Ltd' else c_name end, '(?i)\b(pvt|ltd|limited|llp|inc|corp|company|traders|enterprises|logistics|industries)\b') as org from customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", x.is_organisation(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" Ltd"))).otherwise(F.col("c_name"))).alias("org"))


@query("sc39_field_map", "select s_suppkey as subject, s_name as label, s_acctbal as balance from supplier")
def _(t: Tables) -> DataFrame:
    return x.mapped(t.supplier, {"subject": "s_suppkey", "label": "s_name", "balance": "s_acctbal"})


@query("sc40_flatten_properties", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("sc41_rounding", "select l_orderkey, l_linenumber, round_even(l_discount * 100, 0) as r from lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(F.col("l_discount") * 100, 0).alias("r"))


@query("sc12_score_pair", r"""
with s as (select *, regexp_replace(trim(lower(name)), '\s+', ' ', 'g') as nm from entity),
p as (select a.id as a, b.id as b, a.nm as x, b.nm as y, string_split(a.nm, ' ') as tx, string_split(b.nm, ' ') as ty from s a join s b on a.case_id = b.case_id and split_part(a.nm, ' ', 2) = split_part(b.nm, ' ', 2) and a.entity_type = b.entity_type and a.id < b.id),
j as (select *, len(list_intersect(tx, ty)) / cast(len(list_distinct(list_concat(tx, ty))) as double) as share from p)
select a, b, cast(case when x = y then 1.0 when regexp_matches(x || y, '[0-9]') then 0.0 when share >= .5 then .55 + .35 * share else 0.0 end as double) as score from j""")
def _(t: Tables) -> DataFrame:
    e = t.entity.withColumn("norm", x.normalize_name(F.col("name"))).withColumn("block", F.split_part("norm", F.lit(" "), F.lit(2)))
    return names.scored_in_block(e, ["case_id", "block", "entity_type"])


@query("sc13_context_bonus", "with s as (select o_orderkey, (o_orderkey % 100) / 100.0 as sim, (case when o_orderkey % 2 = 0 then .20 else 0 end) + (case when o_orderkey % 3 = 0 then .15 else 0 end) + (case when o_orderkey % 5 = 0 then .10 else 0 end) as bonus from orders) select o_orderkey, cast(case when bonus > 0 then least(.99, sim + bonus) else sim end as double) as score from s")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", x.with_context(k % 100 / 100.0, x.context_bonus(k % 2 == 0, k % 3 == 0, k % 5 == 0)).alias("score"))


@query("sc21_leading_date", "select o_orderkey, cast(o_orderdate as date) as d from orders")
def _(t: Tables) -> DataFrame:
    line = F.concat(F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" 10:15 seen at the gate"))
    return t.orders.select("o_orderkey", F.to_date(F.regexp_extract(line, r"^\s*(\d{1,2}-\d{1,2}-\d{4})", 1), "dd-MM-yyyy").alias("d"))


@query("sc30_gazetteer", "with p as (select doc_id, text, n from documents cross join (select unnest(['of', 'of the', 'from the', 'der', 'que']) as n)), h as (select doc_id, n from p where contains(' ' || lower(text) || ' ', ' ' || n || ' ')) select doc_id, arg_max(n, length(n) * 1000 - ascii(n)) as place from h group by 1")
def _(t: Tables) -> DataFrame:
    return x.longest_name(t.documents.select("doc_id", "text"), ["of", "of the", "from the", "der", "que"])
