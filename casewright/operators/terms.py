"""Mentions of the terms of a table: names, places and organisations in several scripts, all found in one scan with offsets.

An automaton over the terms goes through a text once, however many terms there are. It is made from a part of the term
table of bounded size, so that what is sent to the workers has a bound; a larger table is several parts, and a scan each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.sequences import ranked

#: Terms of one automaton, and characters of them.
PART_TERMS, PART_CHARS = 200_000, 8_000_000
_FOUND = "term string, start int, stop int"


def _automaton(terms: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, t)
    made.make_automaton()
    return made


def occurrences(automaton, text: str) -> list[tuple[str, int, int]]:
    """(term, start, stop) of every occurrence; those of one term that overlap count once, from the left, as a search for the term alone gives them."""
    out, beyond = [], {}
    for last, term in automaton.iter(text):
        start = last + 1 - len(term)
        if start >= beyond.get(term, 0):
            beyond[term] = last + 1
            out.append((term, start, last + 1))
    return out


def term_mentions(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, columns of ``terms``, start, stop): every occurrence of every ``term`` of the table as a part of a text, case counts; offsets are code points.

    Null texts and null or empty terms have none. A term that stands in several rows of ``terms`` (with another kind, say)
    is found for each. Texts are read once for each part of the table (PART_TERMS terms, or PART_CHARS characters of longer ones).
    """
    spark = texts.sparkSession
    known = terms.select("term").filter("term is not null and term != ''").distinct()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    parts = max(-(-size["n"] // PART_TERMS), -(-size["chars"] // PART_CHARS), 1)
    placed = known if parts == 1 else ranked(known, [F.asc("term")], "_place").withColumn("_part", ((F.col("_place") - 1) % parts).cast("int"))
    kind = dict(texts.dtypes)[key]
    found = None
    for k in range(parts):
        some = placed if parts == 1 else placed.filter(F.col("_part") == k)
        sent = spark.sparkContext.broadcast([r[0] for r in some.select("term").collect()])  # bounded by PART_TERMS and PART_CHARS, but for one longer term
        cell: list = []

        def find(batches: Iterator[pa.RecordBatch], sent=sent, cell=cell) -> Iterator[pa.RecordBatch]:
            if not cell:
                cell.append(_automaton(sent.value) if sent.value else None)
            for batch in batches:
                at, out = [], []
                for i, t in enumerate(batch.column(1).to_pylist() if cell[0] is not None else ()):
                    hits = occurrences(cell[0], t) if t else []
                    out += hits
                    at += [i] * len(hits)
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([h[j] for h in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "term", "start", "stop"])

        hits = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(find, f"_key {kind}, {_FOUND}")
        found = hits if found is None else found.unionByName(hits)
    rest = [c for c in terms.columns if c != "term"]
    return found.join(terms, "term").select(F.col("_key").alias(key), "term", *rest, "start", "stop")


def close_pairs(mentions: DataFrame, key: str, first: Column, second: Column, within: int, name: str = "name") -> DataFrame:
    """(key, a, b) of ``name``s of a mention that is ``first`` and one that is ``second`` and starts ``within`` characters or less after its end, each pair once a key.

    Mentions are dealt to stretches of that length, so a text with very many is not paired in whole.
    """
    size = within + 1
    a = mentions.filter(first).select(key, F.col(name).alias("a"), F.col("stop").alias("_stop"), F.explode(F.array(F.floor(F.col("stop") / size), F.floor(F.col("stop") / size) + 1)).alias("_cell"))
    b = mentions.filter(second).select(key, F.col(name).alias("b"), F.col("start").alias("_start"), F.floor(F.col("start") / size).alias("_cell"))
    near = a.join(b, [key, "_cell"]).filter((F.col("_start") >= F.col("_stop")) & (F.col("_start") - F.col("_stop") <= within))
    return near.select(key, "a", "b").distinct()


def multilingual_claims(lines: DataFrame, key: str, text: str, surfaces: DataFrame, connectives: DataFrame, stamp: str) -> DataFrame:
    """(key, lang, subject, object, stamp): a person's surface and, 30 characters after its end or less, a place's, in lines that hold a connective of the language and a time stamp.

    ``lines`` has ``lang``; ``surfaces`` is (term, lang, kind, name), kind person or location; ``connectives`` is (word, lang), a small table. The
    stamp is the first match of the pattern ``stamp``. Standing together is never enough.
    """
    words = {r["lang"]: r["words"] for r in connectives.groupBy("lang").agg(F.sort_array(F.collect_set("word")).alias("words")).collect()}  # a few words a language
    linked = F.lit(False)
    for lang, some in words.items():
        holds = F.lit(False)
        for w in some:
            holds = holds | F.contains(F.col(text), F.lit(w))
        linked = linked | ((F.col("lang") == lang) & holds)
    said = lines.filter(linked).withColumn("_stamp", F.regexp_extract(text, stamp, 0)).filter("_stamp != ''").select(key, "lang", text, "_stamp")
    found = term_mentions(said, key, text, surfaces.withColumnRenamed("lang", "_of")).join(said.select(key, "lang", "_stamp"), key).filter(F.col("_of") == F.col("lang"))
    pairs = close_pairs(found, key, F.col("kind") == "person", F.col("kind") == "location", 30)
    return pairs.join(said.select(key, "lang", "_stamp"), key).select(key, "lang", F.col("a").alias("subject"), F.col("b").alias("object"), F.col("_stamp").alias("stamp"))


def unknown_names(lines: DataFrame, key: str, text: str, words: str, stop: list[str], known: list[str]) -> DataFrame:
    """(key, name): two neighbouring ``words`` (a pattern of one word), neither a stop word nor one of the ``known`` words, of which the first is not the second of a pair before it."""
    run = F.regexp_extract_all(text, F.lit(words), 0)
    pairs = F.transform(F.slice(run, 1, F.greatest(F.size(run) - 1, F.lit(0))), lambda w, i: F.struct(w.alias("a"), F.get(run, i + 1).alias("b")))
    shut = F.array(*[F.lit(w) for w in [*stop, *known, ""]])
    free = F.filter(pairs, lambda p: ~F.array_contains(shut, p["a"]) & ~F.array_contains(shut, p["b"]))
    first = F.filter(free, lambda p, i: ~F.array_contains(F.transform(F.slice(free, 1, i), lambda q: q["b"]), p["a"]))
    return lines.select(key, F.explode(first).alias("p")).select(key, F.concat_ws(" ", "p.a", "p.b").alias("name"))
