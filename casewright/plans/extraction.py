"""Extraction from case notes (EX): each kind of cue fires in the stand-in notes, and SQL says what it has to give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import extract as e
from casewright.plans.registry import query
from casewright.plans.standin import LAST_NAMES, Tables

_LEXICON = "[" + ", ".join(f"'{w}'" for w in LAST_NAMES) + "]"
#: People of a note in its order, by the lexicon of last names.
_PEOPLE = f"pe as (select note_id, text, list_filter(regexp_extract_all(text, '{e.PERSON_RUN}', 1), lambda r: list_has_any(list_transform(string_split(r, ' '), lambda w: lower(trim(w, '.'))), {_LEXICON})) as people from note)"


def _people(text: str = "text") -> Column:
    return e.persons(F.col(text), LAST_NAMES, ["Inspector"])


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


@query("ex01_note_mentions", _union([f"select note_id, '{k}' as kind, unnest(regexp_extract_all(text, '{p}', {g})) as value from note" for k, (p, g) in e.CASE_PATTERNS.items()]))
def _(t: Tables) -> DataFrame:
    from casewright.functions.text import normalize_digits

    return e.mentions(t.note.withColumn("text", normalize_digits(F.col("text"))), "note_id", "text", e.CASE_PATTERNS)


@query("ex03_capitalised_names", f"with {_PEOPLE} select note_id, unnest(people) as name, .72::double as confidence from pe")
def _(t: Tables) -> DataFrame:
    return t.note.select("note_id", F.explode(_people()).alias("name"), F.lit(0.72).alias("confidence"))


@query("ex04_devanagari_names", "select note_id, 'विकरम सठ' as name, .70::double as confidence from note where contains(text, 'विकरम सठ')")
def _(t: Tables) -> DataFrame:
    found = e.devanagari_persons(F.col("text"), ["pks", "vkrm"], ["के", "ने", "से", "पर", "कहने"])
    return t.note.select("note_id", F.explode(found).alias("name"), F.lit(0.70).alias("confidence"))


@query("ex05_overlap_resolution", f"with {_PEOPLE}, x as (select note_id, unnest(people) as value from pe) select note_id, 'PERSON' as kind, value from x union all select note_id, 'ORG', 'Acme Traders' from note where contains(text, 'Acme Traders') union all select note_id, 'LOCATION', 'Harbour Road' from note where contains(text, 'Harbour Road')")
def _(t: Tables) -> DataFrame:
    """Capitalised runs, an organisation and a place that are capitalised runs as well; an identifier overlaps none."""
    found = e.spans(t.note, "note_id", "text", {"PERSON": e.PERSON_RUN, "ORG": "Acme Traders", "LOCATION": "Harbour Road"}, ["ORG", "LOCATION", "PERSON"])
    return found.select("note_id", "kind", "value")


_CUES = _union(
    [
        f"select note_id, unnest(regexp_extract_all(text, '{p}', 2)) as a, unnest(regexp_extract_all(text, '{p}', 1)) as b, '{r}' as relation, {c}::double as confidence from pe"
        if r == "DIRECTOR_OF"
        else f"select note_id, list_sort(people)[1], unnest(regexp_extract_all(text, '{p}', 1)), '{r}', {c}::double from pe"
        for p, r, c in sorted(e.RELATION_CUES, key=lambda cue: cue[1] != "DIRECTOR_OF")
    ]
)


@query("ex07_relation_cues", f"with {_PEOPLE}, f as ({_CUES}) select note_id, trim(a) as a, trim(b) as b, relation, confidence from f where a is not null and lower(trim(a)) <> lower(trim(b))")
def _(t: Tables) -> DataFrame:
    return e.cue_relations(t.note, "note_id", "text", _people())


_BARE = "trim(v, ' .,' || chr(9) || chr(10))"
_SNAP = f"case when list_contains(people, {_BARE}) then {_BARE} else coalesce(list_filter(people, lambda x: contains({_BARE}, x))[1], trim(v)) end"
_PLAIN = "translate(text, '०१२३४५६७८९', '0123456789')"
_QUOTED = [(p.replace("'", "''"), n, g, c) for p, n, g, c in e.OWNER_CUES]
_OWNERS = _union([f"select note_id, people, {k} as cue, generate_subscripts(regexp_extract_all({_PLAIN}, '{p}', {g}), 1) as spot, unnest(regexp_extract_all({_PLAIN}, '{p}', {g})) as phone, unnest(regexp_extract_all({_PLAIN}, '{p}', {n or g})) as v, {int(n > 0)} as named, {c}::double as confidence from pe" for k, (p, n, g, c) in enumerate(_QUOTED)])


@query("ex08_phone_owners", f"with {_PEOPLE}, f as ({_OWNERS}), o as (select note_id, phone, case when named = 1 then {_SNAP} else people[1] end as owner, confidence, cue, spot from f), z as (select *, row_number() over (partition by note_id, phone order by cue, spot) as n from o where owner is not null) select note_id, phone, owner, confidence from z where n = 1")
def _(t: Tables) -> DataFrame:
    return e.phone_owners(t.note, "note_id", "text", _people())


# Kinds, patterns and confidences of text rules.
TEXT_RULES = [
    ("case", r"\b((?:FIR|CR) ?\d+/\d{4})\b", 1, 0.98), ("phone", r"\b(9\d{9})\b", 1, 0.95), ("vehicle", r"\b([A-Z]{2}\d{1,2}[A-Z]{1,2}\d{3,4})\b", 1, 0.95),
    ("account", r"\b([A-Z]{5}\d{4,6})\b", 1, 0.80), ("location", r"\b(Harbour Road)\b", 1, 0.80), ("person", r"\baccused ([A-Z][a-z]+ [A-Z][a-z]+)", 1, 0.75),
    ("organization", r"\b([A-Z][a-z]+ (?:Traders|Enterprises|Ltd))\b", 1, 0.65), ("event", r"\b(\d{2}/\d{2}/\d{4})\b", 1, 0.80),
]


@query("ex09_text_rules", "select note_id, kind, value, max(confidence) as confidence from (" + _union([f"select note_id, '{k}' as kind, trim(unnest(regexp_extract_all(text, '{p}', {g}))) as value, {c}::double as confidence from note" for k, p, g, c in TEXT_RULES]) + ") group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    return e.rule_entities(t.note, "note_id", "text", TEXT_RULES)


_KIND = "case when regexp_matches(replace({0}, ' ', ''), '^(\\+91-?)?9\\d{{9}}$') then 'phone' when regexp_matches({0}, '^[A-Z]{{2}}\\d{{1,2}}[A-Z]{{1,2}}\\d{{3,4}}$') then 'vehicle' when regexp_matches({0}, '^[A-Z]{{2,5}}\\d{{4,6}}$') then 'account' else 'person' end"
_JOINED = _union([f"select note_id, trim(unnest(regexp_extract_all(text, '{p}', {a}))) as a, trim(unnest(regexp_extract_all(text, '{p}', {b}))) as b, '{r}' as relation, {c}::double as confidence from note" for p, a, b, r, c in e.CONNECTIVES])


@query("ex10_connectives", f"select note_id, {_KIND.format('a')} as a_kind, a, relation, {_KIND.format('b')} as b_kind, b, confidence from ({_JOINED})")
def _(t: Tables) -> DataFrame:
    return e.connective_relations(t.note, "note_id", "text")


@query("ex11_located_at", f"with {_PEOPLE}, a as (select note_id, instr(text, 'Harbour Road') as p, text, people from pe where contains(text, 'Harbour Road')), b as (select note_id, x, instr(text, x) as q, p from a, unnest(people) u(x)) select note_id, arg_max(x, q) as near, 'Harbour Road' as place from b where q < p and p - q <= 80 group by 1")
def _(t: Tables) -> DataFrame:
    """People near a known place that comes with near, at, in or from: the last within 80 characters before, else after."""
    found = e.spans(t.note, "note_id", "text", {"LOCATION": r"(?<=near )Harbour Road|(?<=at )Harbour Road|(?<=in )Harbour Road|(?<=from )Harbour Road", "PERSON": e.PERSON_RUN}, ["LOCATION", "PERSON"])
    near = e.nearest_person(found, "note_id", "LOCATION", "PERSON", 80)
    return near.filter("near is not null").select("note_id", "near", F.col("value").alias("place"))


_CSV = "csv as (select call_id as id, 'Asha' || cast(caller % 9 as varchar) as person, '9' || lpad(caller::varchar, 9, '0') as caller, case when callee % 3 > 0 then '9' || lpad(callee::varchar, 9, '0') else '12' end as callee, tower as place from call where callee is not null)"


def _csv(t: Tables) -> DataFrame:
    tel = lambda c: F.concat(F.lit("9"), F.lpad(F.col(c).cast("string"), 9, "0"))
    return t.call.filter("callee is not null").select(
        F.col("call_id").alias("id"), F.concat(F.lit("Asha"), (F.col("caller") % 9).cast("string")).alias("Full Name"), tel("caller").alias("Caller"),
        F.when(F.col("callee") % 3 > 0, tel("callee")).otherwise("12").alias("callee"), F.col("tower").alias("Cell Tower"), F.lit("x").alias("remarks"),
    )


@query("ex12_csv_roles", f"with {_CSV} select id, 'person' as role, person as value, .90::double as confidence from csv union all select id, 'phone', caller, .95 from csv union all select id, 'phone', callee, .95 from csv union all select id, 'location', place, .80 from csv")
def _(t: Tables) -> DataFrame:
    rows = _csv(t)
    return e.table_entities(rows, "id", e.column_roles(rows.columns))


@query("ex12_csv_pairs", f"with {_CSV} select id, person as a, 'OWNS' as relation, caller as b, .90::double as confidence from csv union all select id, person, 'LOCATED_AT', place, .80 from csv union all select id, caller, 'CALLED', callee, .90 from csv where callee <> '12'")
def _(t: Tables) -> DataFrame:
    rows = _csv(t)
    return e.table_relations(rows, "id", e.column_roles(rows.columns))


_SAID = "said as (select event_id, case when k % 2 = 0 then 'On ' || strftime(ts, '%Y-%m-%d %H:%M') || ', P' || user_id || ' was at Place' || (k % 7) || '.' else 'P' || user_id || ' was at Place' || (k % 7) || ' on ' || strftime(ts, '%Y-%m-%d %H:%M') || '.' end as s, user_id, k, ts from ev where k is not null)"


@query("ex14_claims", f"with {_SAID} select event_id, 'P' || user_id as subject, 'was_at' as predicate, 'Place' || (k % 7) as object, date_trunc('minute', ts) as ts from said where k % 7 < 6")
def _(t: Tables) -> DataFrame:
    """Two sentence forms with a known place and a stamp; places that are not known say nothing."""
    from casewright.functions.text import any_timestamp

    stamp, place = F.date_format("ts", "yyyy-MM-dd HH:mm"), (F.col("k") % 7).cast("string")
    said = F.when(F.col("k") % 2 == 0, F.concat(F.lit("On "), stamp, F.lit(", P"), "user_id", F.lit(" was at Place"), place, F.lit("."))).otherwise(F.concat(F.lit("P"), "user_id", F.lit(" was at Place"), place, F.lit(" on "), stamp, F.lit(".")))
    texts = t.ev.filter("k is not null").select("event_id", said.alias("s"))
    forms = ((r"On (\d{4}-\d{2}-\d{2} \d{2}:\d{2}), (\w+) was at (\w+)", (2, 3, 1)), (r"(\w+) was at (\w+) on (\d{4}-\d{2}-\d{2} \d{2}:\d{2})", (1, 2, 3)))
    claim = F.coalesce(*[F.when(F.col("s").rlike(p), F.struct(*[F.regexp_extract("s", p, g).alias(n) for n, g in zip(("subject", "object", "ts"), groups, strict=True)])) for p, groups in forms])
    known = [f"Place{k}" for k in range(6)]
    return texts.withColumn("c", claim).filter(F.col("c.object").isin(*known)).select(
        "event_id", "c.subject", F.lit("was_at").alias("predicate"), "c.object", any_timestamp(F.col("c.ts"), ["yyyy-MM-dd HH:mm"]).cast("timestamp_ntz").alias("ts")
    )
