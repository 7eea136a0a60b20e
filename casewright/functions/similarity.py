"""Transliteration as Arrow functions of whole columns, and likeness of names as expressions over arrays of words."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.text import skeleton

# Latin of Devanagari consonants, vowels, vowel signs and marks.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "ळ": "l",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
DOTTED = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "ड": "d", "ढ": "dh", "फ": "f"}
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
SIGNS = {"ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"}
MARKS = {"ं": "n", "ँ": "n", "ः": "h"}
NUKTA, VIRAMA = "़", "्"

_SYLLABLE = re.compile(f"([{''.join(CONSONANTS)}])({NUKTA}?)([{''.join(SIGNS)}{VIRAMA}]?)")
_REST = {ord(k): v for k, v in (VOWELS | SIGNS | MARKS).items()} | {ord("०") + k: str(k) for k in range(10)}


def _spoken(m: re.Match) -> str:
    head = DOTTED.get(m[1], CONSONANTS[m[1]]) if m[2] else CONSONANTS[m[1]]
    return head + ("" if m[3] == VIRAMA else SIGNS.get(m[3], "a"))


def latin(text: str | None) -> str:
    """Devanagari by syllables: a consonant without a vowel sign or virama has an a; doubled vowels are one."""
    out = _SYLLABLE.sub(_spoken, unicodedata.normalize("NFD", text or "")).translate(_REST)
    out = re.sub(r"([aeiou])\1+", r"\1", out)
    return re.sub(r"\ba\b", "", out).strip()


def latin_runs(text: str | None) -> str:
    """Only the Devanagari runs of a text."""
    return re.sub(r"[ऀ-ॿ]+", lambda m: latin(m[0]), text or "")


# The second transliterator's letters, where they differ, and its Perso-Arabic letters.
MATCH_LETTERS = {"व": "v", "ङ": "n", "ञ": "n", "छ": "ch", "ळ": "l", "ड़": "r", "ढ़": "rh", "ई": "i", "ऊ": "u", "ी": "i", "ू": "u", "आ": "a", "ा": "a"}
PERSIAN = {
    "ا": "a", "آ": "a", "ب": "b", "پ": "p", "ت": "t", "ٹ": "t", "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ڈ": "d", "ذ": "z", "ر": "r", "ڑ": "r", "ز": "z", "ژ": "zh",
    "س": "s", "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ں": "n", "و": "o", "ہ": "h", "ھ": "h", "ی": "i", "ے": "e",
}
_CLUSTER = re.compile(f"([{''.join(CONSONANTS)}])({NUKTA}?)([{''.join(SIGNS)}]|{VIRAMA}|(?=[{''.join(CONSONANTS)}]))?")


def for_match(text: str | None) -> str:
    """Devanagari and Perso-Arabic in Latin letters for matching only: an inherent a stands before another consonant, not at the end of a word."""

    def part(m: re.Match) -> str:
        head = DOTTED.get(m[1]) if m[2] else None
        head = head or MATCH_LETTERS.get(m[1], CONSONANTS[m[1]])
        if m[3]:
            return head + ("" if m[3] == VIRAMA else MATCH_LETTERS.get(m[3], SIGNS[m[3]]))
        return head + ("a" if m[3] == "" else "")

    out = _CLUSTER.sub(part, unicodedata.normalize("NFD", text or ""))
    rest = {k: MATCH_LETTERS.get(k, v) for k, v in (VOWELS | SIGNS | MARKS).items()} | PERSIAN
    return out.translate({ord(k): v for k, v in rest.items()} | {ord("०") + k: str(k) for k in range(10)})


def _column(function, kind: str, column: str | Column) -> Column:
    """A function of single texts over a column, a batch at a time and once for each distinct text of it; texts in ASCII do not come here."""

    @F.pandas_udf(kind)
    def batch(values: pd.Series) -> pd.Series:
        return values.map({v: function(v) for v in values.dropna().unique()}).astype(object).where(values.notna(), None)

    return batch(column)


def _unless_ascii(function, column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    plain = ~c.rlike("[^\\x00-\\x7F]")
    return F.when(plain, c).otherwise(_column(function, "string", F.when(~plain, c)))


def to_latin(text: str | Column) -> Column:
    return F.trim(_unless_ascii(latin, text))


def runs_to_latin(text: str | Column) -> Column:
    return _unless_ascii(latin_runs, text)


def match_latin(text: str | Column) -> Column:
    return _unless_ascii(for_match, text)


# --- likeness of names, as expressions over arrays of words ---------------------------------------------------------
def name_words(name: str | Column) -> Column:
    """Words of a name in Latin letters, lower case, letters only."""
    words = F.transform(F.split(F.lower(runs_to_latin(name)), r"[\s.]+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w != "")


def long_sounds(words: Column) -> Column:
    """Distinct skeletons of the words of four letters or more: names without a common one are not alike at all, so these are the blocks of a join."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 4), skeleton))


def words_likeness(x: Column, y: Column) -> Column:
    """0 to 1 for two arrays of words.

    0 without a common long sound. Each word of the first, in order, takes the first free word of the second that sounds
    the same or of which one is the initial. If all words of the shorter name are taken, two or more, and two sounds of it are
    long, that is 1, or .85 if the other has two words more; else the taken words' share of the longer name.
    """
    alike = lambda v, w: F.when((F.length(v) > 1) & (F.length(w) > 1), (v == w) | ((skeleton(v) == skeleton(w)) & (skeleton(v) != ""))).otherwise(v.startswith(w) | w.startswith(v))
    places = lambda free, w: F.filter(free, lambda k: alike(F.get(y, k), w))
    free = F.aggregate(x, F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>")), lambda free, w: F.array_except(free, F.slice(places(free, w), 1, 1)))
    taken, few, many = F.size(y) - F.size(free), F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    long_few = F.size(F.when(F.size(x) <= F.size(y), long_sounds(x)).otherwise(long_sounds(y)))
    whole = (taken == few) & (few >= 2) & (long_few >= 2)
    return (
        F.when(few == 0, 0.0).when(x == y, 1.0).when(~F.arrays_overlap(long_sounds(x), long_sounds(y)), 0.0)
        .when(whole & (many - few <= 1), 1.0).when(whole, 0.85).otherwise(taken / many)
    )


def name_likeness(a: str | Column, b: str | Column) -> Column:
    both = F.array(F.struct(name_words(a).alias("x"), name_words(b).alias("y")))  # bound once: the rule below uses each many times
    return F.get(F.transform(both, lambda p: words_likeness(p["x"], p["y"])), 0)


def name_clusters(names: Column, least: float = 0.75) -> Column:
    """Array of clusters (arrays of the names) of an array of (name, words): each name, in order, goes to the first cluster of which some name is alike."""
    member = "struct<name:string,words:array<string>>"
    empty = F.array().cast(f"array<array<{member}>>")

    def put(clusters: Column, n: Column) -> Column:
        home = F.array_min(F.filter(F.transform(clusters, lambda c, k: F.when(F.exists(c, lambda m: words_likeness(m["words"], n["words"]) >= least), k)), lambda k: k.isNotNull()))
        joined = F.transform(clusters, lambda c, k: F.when(k == home, F.concat(c, F.array(n))).otherwise(c))
        return F.when(home.isNull(), F.concat(clusters, F.array(F.array(n)))).otherwise(joined).cast(f"array<array<{member}>>")

    return F.transform(F.aggregate(names.cast(f"array<{member}>"), empty, put), lambda c: F.transform(c, lambda m: m["name"]))


# What stands before and after the four digits of a clock time. A span without "from" is no span.
CLOCK_FORMS = ((r"at\s+(?:approximately\s+)?", r"\s*hrs\b"), (r"from\s+", r"\s+to\s+\d{4}\s*hrs\b"), ("", r"\s*hrs\b"))
_CLOCKS = [re.compile(rf"\b{lead}(?P<h>\d\d)(?P<m>\d\d){tail}", re.IGNORECASE) for lead, tail in CLOCK_FORMS]


def clock_times(text: str | None) -> list[tuple[int, int, int]]:
    """(position, hour, minute) of times of day, by position: that of the lead-in where there is one, and the digits' own."""
    found = {m.start(): (int(m["h"]), int(m["m"])) for form in reversed(_CLOCKS) for m in form.finditer(text or "")}
    return [(at, h, minute) for at, (h, minute) in sorted(found.items()) if h < 24 and minute < 60]


def stated_time(text: str | None, anchor: str | None, day: str) -> str | None:
    """The time nearest to the first mention of the anchor on ``day``; null if either is missing."""
    at = (text or "").find(anchor) if anchor else -1
    times = clock_times(text)
    if at < 0 or not times:
        return None
    _, h, m = min(times, key=lambda t: abs(t[0] - at))
    return f"{day}T{h:02d}:{m:02d}:00"
