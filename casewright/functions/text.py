"""Text scalars: names, scripts, identifiers, amounts, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Devanagari digits and their ASCII ones.
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def normalize_digits(text: Column) -> Column:
    """Devanagari digits as ASCII ones."""
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def has_devanagari(text: Column) -> Column:
    return text.rlike("[ऀ-ॿ]")


def normalize_name(name: Column) -> Column:
    """Identity key of a name: lower case, trimmed, white space squeezed."""
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")


def skeleton(word: Column) -> Column:
    """Consonant skeleton: letters only, similar consonants unified, vowels dropped after the first letter, repeats collapsed."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    unified = F.translate(F.replace(letters, F.lit("ph"), F.lit("f")), "qzwx", "kjvk")
    head, tail = F.substring(unified, 1, 1), F.regexp_replace(F.substring(unified, 2, 1 << 20), "[aeiouy]", "")
    return F.regexp_replace(F.concat(head, tail), r"(.)\1+", "$1")


def name_key(name: Column) -> Column:
    """Skeletons of the words of a name in order, joined by a blank."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(name, r"[\s.]+"), skeleton), lambda s: s != "")), " ")


def snippet(text: Column, limit: int = 240) -> Column:
    """White space squeezed, cut at ``limit`` characters."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(limit))


def context(text: Column, start: Column, end: Column, window: int = 90) -> Column:
    """``window`` characters at either side of [start, end) (0-based), with an ellipsis where text is left out."""
    lo, hi = F.greatest(start - window, F.lit(0)), F.least(end + window, F.length(text))
    piece = F.trim(F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int")))
    return F.concat(F.when(lo > 0, "…").otherwise(""), piece, F.when(hi < F.length(text), "…").otherwise(""))


def phone(raw: Column) -> Column:
    """Last ten digits."""
    return F.right(F.regexp_replace(raw, "[^0-9]", ""), F.lit(10))


def vehicle(raw: Column) -> Column:
    """Upper-case letters and digits."""
    return F.regexp_replace(F.upper(raw), "[^A-Z0-9]", "")


def match_score(value: Column, query: str) -> Column:
    """1 for the query itself, 0.9 if it begins the value, 0.75 if it is inside, else 0; case does not count."""
    v, q = F.lower(F.trim(value)), query.strip().lower()
    return F.when(v == q, 1.0).when(v.startswith(q), 0.9).when(F.contains(v, F.lit(q)), 0.75).otherwise(0.0)


def amount(text: Column) -> Column:
    """First amount in a text, with crore, lakh or k as multiplier; null if there is none."""
    pattern = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crore|cr|lakh|lac|k|thousand)?\b"
    number = F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), ",", "").cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    return number * F.when(unit.isin("crore", "cr"), 1e7).when(unit.isin("lakh", "lac"), 1e5).when(unit.isin("k", "thousand"), 1e3).otherwise(1.0)


def by_keyword(text: Column, families: list[tuple[str, str]], other: str) -> Column:
    """Name of the first family whose pattern is in the text."""
    return reduce(lambda rest, f: F.when(text.rlike("(?i)" + f[1]), f[0]).otherwise(rest), reversed(families), F.lit(other))


def org_id(name: Column) -> Column:
    """Stable id of an organisation."""
    return F.concat(F.lit("O-"), F.left(F.sha1(F.encode(name, "utf-8")), F.lit(8)))


def is_organisation(name: Column) -> Column:
    return name.rlike(r"(?i)\b(pvt|ltd|limited|llp|inc|corp|company|traders|enterprises|logistics|industries)\b")


def jaccard(a: Column, b: Column) -> Column:
    """Shared items over all items; null if there are none."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def score_pair(a: Column, b: Column) -> Column:
    """Likeness of two names, a ladder of rules: see the branches. Not monotone in the token overlap."""
    x, y = normalize_name(a), normalize_name(b)
    tx, ty = F.split(x, " "), F.split(y, " ")
    only_x, only_y = F.array_except(tx, ty), F.array_except(ty, tx)
    p, q = F.get(only_x, 0), F.get(only_y, 0)
    one_each = (F.size(tx) == F.size(ty)) & (F.size(only_x) == 1) & (F.size(only_y) == 1)
    initial = ((F.length(p) == 1) | (F.length(q) == 1)) & (F.left(p, F.lit(1)) == F.left(q, F.lit(1)))
    near = (F.length(p) >= 3) & (F.length(q) >= 3) & F.levenshtein(p, q).between(0, 1)
    share = jaccard(tx, ty)
    return (
        F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.rlike("[0-9]") | y.rlike("[0-9]"), 0.0)
        .when(one_each & initial, 0.82).when(one_each & near, 0.75).when(share >= 0.5, 0.55 + 0.35 * share).otherwise(0.0)
    )


def with_context(similarity: Column, bonus: Column) -> Column:
    """Similarity with a bonus of shared identifiers, capped at .99 only if there is a bonus."""
    return F.when(bonus > 0, F.least(F.lit(0.99), similarity + bonus)).otherwise(similarity)


def context_bonus(phones: Column, accounts: Column, places: Column) -> Column:
    """.20 for a shared phone or vehicle, .15 for an account or e-mail, .10 for a place."""
    return F.when(phones, 0.20).otherwise(0.0) + F.when(accounts, 0.15).otherwise(0.0) + F.when(places, 0.10).otherwise(0.0)


def language(text: Column, words: dict[str, list[str]]) -> Column:
    """Language whose function words the text has most of (distinct words; ties by order), null without any."""
    mine = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    hits = {lang: F.size(F.array_intersect(mine, F.array(*[F.lit(w) for w in some]))) for lang, some in words.items()}
    most = F.greatest(*hits.values())
    return reduce(lambda rest, lang: F.when((hits[lang] == most) & (most > 0), lang).otherwise(rest), reversed(list(words)), F.lit(None))


def normalize_for_match(name: Column) -> Column:
    """Lower case, all but ASCII letters and digits as blanks, doubled a, e, o as one, blanks squeezed."""
    out = F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")
    for vowel in "aeo":
        out = F.regexp_replace(out, vowel + "{2,}", vowel)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def norm_tokens(name: Column, variants: dict[str, str], noise: list[str]) -> Column:
    """Words in lower case, variants unified, noise words left out."""
    unify = lambda w: reduce(lambda rest, v: F.when(w == v[0], v[1]).otherwise(rest), variants.items(), w)
    return F.filter(F.transform(F.split(F.lower(name), " "), unify), lambda w: ~w.isin(*noise, ""))


def any_timestamp(text: Column, formats: list[str]) -> Column:
    """The first format that reads the text, null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def ranges_overlap(spans: Column) -> Column:
    """Aggregate: whether all spans yyyy-yyyy share a year; false if one can't be read."""
    ends = [F.regexp_extract(spans, r"^\s*(\d{4})\s*-\s*(\d{4})\s*$", k) for k in (1, 2)]
    readable = F.min((ends[0] != "").cast("int")) == 1
    return readable & (F.max(F.nullif(ends[0], F.lit("")).cast("int")) <= F.min(F.nullif(ends[1], F.lit("")).cast("int")))


def version_hash(lines: DataFrame, key: str) -> DataFrame:
    """16 digits of the SHA-256 of the lines (o, id, line) of each key in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("o", "id", "line"))), lambda s: s["line"])
    return lines.groupBy(key).agg(F.left(F.sha2(F.encode(F.array_join(ordered, ""), "utf-8"), 256), F.lit(16)).alias("version"))


def mapped(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns of another schema under our names."""
    return df.select(*[F.col(theirs).alias(ours) for ours, theirs in fields.items()])


def longest_name(texts: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, place): the longest listed name that is in a text as whole words; texts without one are left out. One scan of the texts."""
    low = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    order = sorted(names, key=lambda n: (-len(n), n))
    found = F.coalesce(*[F.when(F.contains(low, F.lit(f" {n} ")), F.lit(n)) for n in order])
    return texts.select("doc_id", found.alias("place")).filter("place is not null")
