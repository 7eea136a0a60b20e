"""Mentions and relations in texts, as expressions where the pattern is a regular expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import normalize_digits

# Patterns of the mention types.
PATTERNS = {
    "PHONE": r"(?<![0-9])[6-9][0-9]{9}(?![0-9])",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IPV4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
    "VEHICLE": r"[A-Z]{2}[0-9]{1,2}[A-Z]{1,2}[0-9]{4}",
    "ACCOUNT": r"(?<![0-9])[0-9]{11,16}(?![0-9])",
}


# Patterns of identifiers in case texts and the group that is the value; all have confidence CERTAIN.
CASE_PATTERNS = {
    "PHONE": (r"\b([6-9]\d{9})\b", 1), "VEHICLE": (r"\b(MH\s?\d{2}\s?[A-Z]{1,2}\s?\d{3,4})\b", 1), "ACCOUNT": (r"\b(AC[A-Z]{3}\d{4})\b", 1),
    "MONEY": (r"(?i)(?:\bRs\.?|\bINR\b|₹)\s?(\d[\d,]*(?:\.\d+)?)", 1), "DATE": (r"\b(\d{2}/\d{2}/\d{4})\b", 1), "IMEI": (r"\b(\d{15})\b", 1),
}
CERTAIN = 0.97
# Cue phrases of relations (pattern, relation, confidence); the last group is the target, of DIRECTOR_OF the subject.
RELATION_CUES = [
    (r"on instructions of (?:one )?([A-Z][\w.\s]{3,30}?)(?:,|\s+who|\s+is|\.)", "INSTRUCTED_BY", 0.80),
    (r"(?:is )?(?:reportedly )?working under ([A-Z][\w.\s]{3,30}?)(?:\.|,)", "REPORTS_TO", 0.80),
    (r"handed over to him by ([A-Z][\w.\s]{3,30}?)(?: at|\.|,)", "SUPPLIED_BY", 0.78),
    (r"procuring the material from ([A-Z][\w.\s]{3,30}?)(?:\.|,)", "SUPPLIED_BY", 0.78),
    (r"involvement of ([A-Z][\w.\s]{3,30}?) in", "ASSOCIATE_OF", 0.65),
    (r"director of ([A-Z][\w.\s&-]{3,40}?) is recorded as ([A-Z][\w.\s]{3,30}?)(?:,|\.)", "DIRECTOR_OF", 0.90),
    (r"([ऀ-ॿ]+(?:\s[ऀ-ॿ]+){0,2})\s+के कहने पर", "INSTRUCTED_BY", 0.80),
    (r"([ऀ-ॿ]+(?:\s[ऀ-ॿ]+){0,2})\s+के लिए काम करता है", "REPORTS_TO", 0.80),
    (r"([ऀ-ॿ]+(?:\s[ऀ-ॿ]+){0,2})\s+से माल लिया", "SUPPLIED_BY", 0.78),
]
# Cue phrases of phone owners (pattern, group of the name or 0 for the first person named, group of the phone, confidence).
OWNER_CUES = [
    (r"([ऀ-ॿ]+(?:\s[ऀ-ॿ]+){0,2})\s*\(मो\.?\s*(\d{10})\)", 1, 2, 0.95),
    (r"मोबाइल नंबर\s+(\d{10})\s+से किए गए", 0, 1, 0.85),
    (r"आरोपी मोबाइल\s+(\d{10})", 0, 1, 0.85),
    (r"([A-Z][\w.\s']{2,30}?)\s*\(mob\.?\s*(\d{10})\)", 1, 2, 0.95),
    (r"issued to\s+([A-Z][\w.\s']{2,30}?)\s+at mobile\s+(\d{10})", 1, 2, 0.93),
    (r"Contact number of accused\s+([A-Z][\w.\s']{2,30}?)\s+is\s+(\d{10})", 1, 2, 0.93),
    (r"Mobile number\s+(\d{10})\s+was used to make threatening calls", 0, 1, 0.85),
    (r"[Aa]ccused was using mobile\s+(\d{10})", 0, 1, 0.85),
    (r"number established as\s+(\d{10})", 0, 1, 0.88),
    (r"known number\s+(\d{10})", 0, 1, 0.90),
]
# Connectives (pattern, group of the source, group of the target, relation, confidence). Standing together is never enough.
CONNECTIVES = [
    (r"(?i)((?:\+91[\s-]?)?9\d{9}|\b[A-Z][a-z]+\s+[A-Z][a-z]+\b)\s+called\s+((?:\+91[\s-]?)?9\d{9}|\b[A-Z][a-z]+\s+[A-Z][a-z]+\b)", 1, 2, "CALLED", 0.80),
    (r"(?is)vehicle\s+([A-Z]{2}\d{1,2}[A-Z]{1,2}\d{3,4})\b.{0,60}?\b(?:of|registered to|owned by)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 2, 1, "OWNS", 0.85),
    (r"(?i)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+arrived in (?:a |the )?vehicle\s+([A-Z]{2}\d{1,2}[A-Z]{1,2}\d{3,4})", 1, 2, "USED", 0.75),
    (r"(?i)transfer(?:red)?\b.{0,40}?\bfrom\s+([A-Z]{2,5}\d{4,6})\b.{0,40}?\bto\s+([A-Z]{2,5}\d{4,6})", 1, 2, "TRANSFERRED_TO", 0.85),
]
# A capitalised run of two or three words, initials too, and two or three Devanagari words.
PERSON_RUN = r"\b((?:[A-Z]\.[ \t]?|[A-Z][a-z]{2,}[ \t]){1,2}[A-Z][a-z]{2,})\b"
DEVANAGARI_RUN = r"([ऀ-ॿ]{2,}(?:[ \t][ऀ-ॿ]{2,}){1,2})"
# Roles of columns by header, confidence of a value of each role, and what a person's row says of the others in it.
COLUMN_ROLES = {
    "person": "person name party individual suspect person_name full_name", "phone": "phone mobile phone_number contact handset number caller callee call_from call_to",
    "vehicle": "vehicle vehicle_no vehicle_number reg_no registration vehicle_registration", "location": "location place address area cell_tower station city",
    "account": "account account_no bank_account from_account to_account acct", "organization": "organization org company firm organisation", "case_reference": "case case_number case_ref case_reference",
}
ROLE_CONFIDENCE = {"person": 0.90, "phone": 0.95, "vehicle": 0.95, "location": 0.80, "account": 0.80, "organization": 0.90, "case_reference": 0.98}
ROLE_PAIRS = {"phone": ("OWNS", 0.90), "vehicle": ("OWNS", 0.90), "location": ("LOCATED_AT", 0.80), "case_reference": ("INVOLVED_IN", 0.80), "organization": ("ASSOCIATED_WITH", 0.70), "account": ("OWNS", 0.85)}
COLUMN_PAIRS = (("caller", "callee", "phone", r"^(?:\+91[\s-]?)?9\d{9}$", "CALLED", 0.90), ("from_account", "to_account", "account", r"^[A-Z]{2,5}\d{4,6}$", "TRANSFERRED_TO", 0.90))


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def mentions(texts: DataFrame, key: str, text: str, patterns: dict[str, str | tuple[str, int]]) -> DataFrame:
    """(key, kind, value) of every match (or of a group of it), in one scan."""
    of = {k: p if isinstance(p, tuple) else (p, 0) for k, p in patterns.items()}
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), g), _tagged(k)) for k, (p, g) in of.items()]))
    return texts.select(key, F.explode(found).alias("m")).select(key, "m.kind", "m.value")


def rule_entities(texts: DataFrame, key: str, text: str, rules: list[tuple[str, str, int, float]]) -> DataFrame:
    """(key, kind, value, confidence) of rules (kind, pattern, group, confidence): of equal values of a kind in a text the most confident."""
    tag = lambda k, c: lambda v: F.struct(F.lit(k).alias("kind"), F.trim(v).alias("value"), F.lit(c).alias("confidence"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), g), tag(k, c)) for k, p, g, c in rules]))
    return texts.select(key, F.explode(found).alias("m")).groupBy(key, "m.kind", "m.value").agg(F.max("m.confidence").alias("confidence"))


def persons(text: Column, lexicon: list[str], titles: list[str] = []) -> Column:  # noqa: B006
    """Array of the capitalised runs of a text that hold a word of the lexicon and do not begin with a title."""
    words = lambda run: F.transform(F.split(run, r"\s+"), lambda w: F.lower(F.btrim(w, F.lit("."))))
    known = F.array(*[F.lit(w) for w in lexicon])
    first = lambda run: F.regexp_replace(F.get(F.split(run, r"\s+"), 0), r"\.$", "")
    return F.filter(F.regexp_extract_all(text, F.lit(PERSON_RUN), 1), lambda run: F.arrays_overlap(words(run), known) & ~first(run).isin(*(titles or [""])))


def devanagari_persons(text: Column, sounds: list[str], stop: list[str]) -> Column:
    """Array of runs of two or three Devanagari words without a function word, of which some word sounds like a known name (skeletons)."""
    from casewright.functions.text import skeleton

    return F.filter(
        F.regexp_extract_all(text, F.lit(DEVANAGARI_RUN), 1),
        lambda run: ~F.arrays_overlap(F.split(run, r"\s+"), F.array(*[F.lit(w) for w in stop])) & F.arrays_overlap(F.transform(F.split(spoken(run), r"\s+"), skeleton), F.array(*[F.lit(w) for w in sounds])),
    )


def spoken(run: Column) -> Column:
    """Devanagari consonants by their Latin ones, vowels and signs left out: enough for a skeleton, and inside an expression."""
    from casewright.functions.similarity import CONSONANTS

    one = {k: v for k, v in CONSONANTS.items() if len(v) == 1}
    out = F.translate(run, "".join(one), "".join(one.values()))
    for k, v in CONSONANTS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, "[ऀ-ॿ]", "")


def cue_relations(texts: DataFrame, key: str, text: str, people: Column) -> DataFrame:
    """(key, a, b, relation, confidence) of the relation cues: from the alphabetically first of ``people`` (an array of names) to the cue's last group. Devanagari digits count as ASCII ones; nobody is related to themselves, case ignored."""
    first, text = F.array_min(people), normalize_digits(F.col(text))
    pair = lambda r, c: lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.lit(r).alias("relation"), F.lit(c).alias("confidence"))
    out = []
    for pattern, relation, sure in RELATION_CUES:
        if relation == "DIRECTOR_OF":
            ends = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 2).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("b"))
        else:
            ends = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(first.alias("a"), v.alias("b")))
        out.append(F.transform(ends, pair(relation, sure)))
    found = texts.select(key, F.explode(F.flatten(F.array(*out))).alias("m")).select(key, F.trim("m.a").alias("a"), F.trim("m.b").alias("b"), "m.relation", "m.confidence")
    return found.filter("a is not null and lower(a) != lower(b)")


def phone_owners(texts: DataFrame, key: str, text: str, people: Column) -> DataFrame:
    """(key, phone, owner, confidence) of the owner cues: the captured name, or the one of ``people`` (names in the order of the text) that it holds; the first of them where the cue names none.

    Devanagari digits count as ASCII ones; commas and points at the ends of a captured name do not keep it from being one of
    ``people``. Of several owners of a phone in a text the one of the earlier cue stays, of one cue the first.
    """
    bare = lambda v: F.btrim(v, F.lit(" \t\n.,"))
    snap = lambda v: F.when(F.array_contains(people, bare(v)), bare(v)).otherwise(F.coalesce(F.get(F.filter(people, lambda n: F.contains(bare(v), n)), 0), F.trim(v)))
    plain = normalize_digits(F.col(text))
    owned = lambda cue, named, c: lambda p, at: F.struct(F.lit(cue).alias("cue"), at.alias("at"), p["phone"].alias("phone"), (snap(p["name"]) if named else F.get(people, 0)).alias("owner"), F.lit(c).alias("confidence"))
    out = []
    for cue, (pattern, name, phone, sure) in enumerate(OWNER_CUES):
        every = lambda g: F.regexp_extract_all(plain, F.lit(pattern), F.lit(g))  # noqa: B023, E731
        both = F.arrays_zip(every(phone).alias("phone"), every(name or phone).alias("name"))
        out.append(F.transform(both, owned(cue, name, sure)))
    found = texts.select(key, F.explode(F.flatten(F.array(*out))).alias("m")).filter("m.owner is not null")
    return found.groupBy(key, "m.phone").agg(F.min("m").alias("m")).select(key, "phone", "m.owner", "m.confidence")


def kind_of(value: Column) -> Column:
    """Kind of an end of a relation by its shape."""
    v = F.trim(value)
    return F.when(F.replace(v, F.lit(" ")).rlike(r"^(\+91-?)?9\d{9}$"), "phone").when(v.rlike(r"^[A-Z]{2}\d{1,2}[A-Z]{1,2}\d{3,4}$"), "vehicle").when(v.rlike(r"^[A-Z]{2,5}\d{4,6}$"), "account").otherwise("person")


def connective_relations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, a_kind, a, relation, b_kind, b, confidence) of pairs that a connective joins."""
    tag = lambda r, c: lambda p: F.struct(F.trim(p["a"]).alias("a"), F.trim(p["b"]).alias("b"), F.lit(r).alias("relation"), F.lit(c).alias("confidence"))
    out = []
    for pattern, a, b, relation, sure in CONNECTIVES:
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), a).alias("a"), F.regexp_extract_all(text, F.lit(pattern), b).alias("b"))
        out.append(F.transform(both, tag(relation, sure)))
    found = texts.select(key, F.explode(F.flatten(F.array(*out))).alias("m"))
    return found.select(key, kind_of(F.col("m.a")).alias("a_kind"), "m.a", "m.relation", kind_of(F.col("m.b")).alias("b_kind"), "m.b", "m.confidence")


def column_roles(columns: list[str]) -> dict[str, str]:
    """Role of each column by its header; columns without one are left out."""
    plain = {c: c.strip().lower().replace(" ", "_") for c in columns}
    return {c: role for c, k in plain.items() for role, words in COLUMN_ROLES.items() if k in words.split()}


def table_entities(rows: DataFrame, key: str, roles: dict[str, str]) -> DataFrame:
    """(key, role, value, confidence) of every filled cell of a column with a role."""
    cells = F.array(*[F.struct(F.lit(r).alias("role"), F.trim(F.col(c)).alias("value"), F.lit(ROLE_CONFIDENCE[r]).alias("confidence")) for c, r in roles.items()])
    return rows.select(key, F.explode(cells).alias("m")).select(key, "m.*").filter("value != ''")


def table_relations(rows: DataFrame, key: str, roles: dict[str, str]) -> DataFrame:
    """(key, a, relation, b, confidence): a row's first person with the first value of each other role, and caller with callee, account with account."""
    first = lambda role: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c, r in roles.items() if r == role], F.lit(None).cast("string"))
    pair = lambda a, r, b, c: F.struct(a.alias("a"), F.lit(r).alias("relation"), b.alias("b"), F.lit(c).alias("confidence"))
    out = [pair(first("person"), relation, first(role), sure) for role, (relation, sure) in ROLE_PAIRS.items()]
    named = {c.strip().lower().replace(" ", "_"): c for c in roles}
    for a, b, _, shape, relation, sure in COLUMN_PAIRS:
        if a in named and b in named:
            x, y = F.trim(F.col(named[a])), F.trim(F.col(named[b]))
            out.append(pair(F.when(x.rlike(shape), x), relation, F.when(y.rlike(shape), y), sure))
    return rows.select(key, F.explode(F.array(*out)).alias("m")).select(key, "m.*").filter("a is not null and b is not null")


def gazetteer(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term) of the terms that a text holds, case counts; the list is an argument, not a table."""
    hits = F.filter(F.array(*[F.when(F.contains(F.col(text), F.lit(t)), F.lit(t)) for t in terms]), lambda v: v.isNotNull())
    return texts.select(key, F.explode(hits).alias("term"))


def resolved(found: list[tuple], order: dict[str, int]) -> list[tuple]:
    """Of overlapping (start, stop, kind, value) those that stay, taken by start, longest first, earlier in ``order`` first.

    One of a kind that is still open shuts out a later one; of two kinds in ``order`` the earlier in it stays and the other goes, also if it
    came first; other kinds stand side by side. Only spans that reach beyond the start are looked at.
    """
    out: list[list] = []
    live: list[list] = []  # span and whether it stays
    for span in sorted(found, key=lambda s: (s[0], -s[1], order.get(s[2], len(order)))):
        start, kind = span[0], span[2]
        live = [x for x in live if x[1] and x[0][1] > start]
        stays = True
        for other in live:
            rival = other[0][2]
            if rival == kind or rival in order and kind in order and order[rival] <= order[kind]:
                stays = False
                break
            if rival in order and kind in order:
                other[1] = False
        if stays:
            live.append(entry := [span, True])
            out.append(entry)
    return [span for span, stays in out if stays]


def spans(texts: DataFrame, key: str, text: str, patterns: dict[str, str], rank: list[str]) -> DataFrame:
    """(key, kind, start, stop, value): matches with offsets, overlaps resolved; kinds in ``rank`` give way to earlier ones in it."""
    import re

    compiled = {k: re.compile(p) for k, p in patterns.items()}
    order = {k: i for i, k in enumerate(rank)}

    def find(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):  # what is held follows a few texts, not the batch
                out = []
                for k, t in zip(batch[key].iloc[lo : lo + 512], batch[text].iloc[lo : lo + 512], strict=True):
                    found = [(m.start(), m.end(), kind, m.group()) for kind, p in compiled.items() for m in p.finditer(t or "")]
                    out += [(k, kind, start, stop, value) for start, stop, kind, value in resolved(found, order)]
                yield pd.DataFrame(out, columns=[key, "kind", "start", "stop", "value"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(find, f"{key} {kind}, kind string, start long, stop long, value string")


def nearest_person(marks: DataFrame, key: str, anchor: str, target: str, within: int) -> DataFrame:
    """(key, start, value, near): each ``anchor`` span with the last ``target`` of the ``within`` characters before it, else the last of those after it.

    Both are dealt to stretches of ``within`` characters, so a long text with many spans is not paired in whole.
    """
    a = marks.filter(F.col("kind") == anchor).select(key, "start", "stop", "value")
    b = marks.filter(F.col("kind") == target).select(key, F.col("start").alias("from"), F.col("stop").alias("to"), F.col("value").alias("other"))
    size = 2 * within
    near_a = a.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - within) / size), F.floor((F.col("stop") + within) / size))))
    hit = near_a.join(b.withColumn("cell", F.floor(F.col("from") / size)), [key, "cell"])
    before = (F.col("to") <= F.col("start")) & (F.col("from") >= F.col("start") - within)
    after = (F.col("from") >= F.col("stop")) & (F.col("to") <= F.col("stop") + within)
    best = hit.filter(before | after).groupBy(key, "start").agg(F.max(F.struct(before.alias("before"), "from", "other"))["other"].alias("near"))
    return a.drop("stop").join(best, [key, "start"], "left")
