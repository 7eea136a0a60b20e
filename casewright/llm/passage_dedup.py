"""Substring deduplication by words: every run of ``width`` words or more that stands earlier is found, whatever lines it is in.

Runs of ``width`` words (windows) are compared, all of them, but only those are sent that can repeat: the smallest hash of
half as many words inside a window depends on the window's words only, so a window repeats only if that hash does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import _BLANK, _batches, mix64, small_batches, stored, word_hashes

_MARKS = "row long, pos int, mark long"
_WINDOWS = "id long, row long, pos int, start int, stop int, digest long"


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += words[j : n + j] * np.uint64(pow(0xD1342543DE82EF95, j, 1 << 64))
    return mix64(out)


def windows(texts: list[bytes], width: int):
    """(document, first word) of each word, hashes of the parts, windows that are inside one text and the place of each window's smallest part."""
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(words) < width:
        return None
    begin = (np.cumsum(counts) - counts)[doc]
    part = width // 2
    parts = _grams(words, part)
    n = len(words) - width + 1
    best, at = parts[:n].copy(), np.arange(n)
    for j in range(1, width - part + 1):
        less = parts[j : n + j] < best
        best[less] = parts[j : n + j][less]
        at[less] = np.flatnonzero(less) + j
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return words, doc, begin, parts, inside, at[inside]


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word of all texts, in code points of its own text."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    base = chars[np.concatenate([[0], ends[:-1]])][np.searchsorted(ends, start, side="right")]
    return chars[start] - base, chars[stop] - base


def as_bytes(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _marks(width: int):
    def mark(batches):
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(zero_copy_only=False), as_bytes(batch.column(1))
            for lo, hi in _batches(texts):
                if (made := windows(texts[lo:hi], width)) is not None:
                    _, doc, begin, parts, _, at = made
                    at = np.unique(at)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[lo:hi][doc[at]]), pa.array((at - begin[at]).astype(np.int32)), pa.array(parts[at].view(np.int64))], names=["row", "pos", "mark"])

    return mark


def _candidates(width: int):
    def cut(batches):
        for batch in batches:
            ids, rows, texts, marks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), as_bytes(batch.column(2)), batch.column(3).to_pylist()
            for lo, hi in _batches(texts):
                if (made := windows(texts[lo:hi], width)) is None:
                    continue
                words, doc, begin, _, inside, at = made
                marked = np.zeros(len(words), dtype=bool)
                first = np.searchsorted(doc, np.arange(hi - lo))
                for k in range(hi - lo):
                    marked[first[k] + np.array(marks[lo + k], dtype=np.int64)] = True
                take = inside[marked[at]]
                start, stop = code_points(texts[lo:hi])
                found = (rows[lo:hi][doc[take]], (take - begin[take]).astype(np.int32), start[take].astype(np.int32), stop[take + width - 1].astype(np.int32), _grams(words, width)[take].view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[take] + lo)), *map(pa.array, found)], names=["id", "row", "pos", "start", "stop", "digest"])

    return cut


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row per passage to cut: id, row, passage_no, start, stop (code points, stop not included), words, first_id.

    A word goes if it is in a run of ``width`` words that stands earlier, in the order of id (null last), row, place,
    without sharing a word with that earlier place; words that go and follow each other are one passage, which can be
    put together from several earlier places (``first_id`` is that of its first words). A-Z and white space count as in
    ``repeated_units``. Rows that repeat an id count as documents of their own.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    marks = stored(base.select("row", "text").mapInArrow(_marks(width), _MARKS), "marks")
    again = marks.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    places = marks.join(again, "mark").groupBy(F.col("row").alias("at")).agg(F.collect_list("pos").alias("places"))
    found = stored(base.join(places, F.col("row") == F.col("at")).select("id", "row", "text", "places").mapInArrow(_candidates(width), _WINDOWS), "windows")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"), F.col("pos").alias("d"))
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = found.join(first, "digest").filter((F.col("row") != F.col("first.c")) | (F.col("pos") >= F.col("first.d") + width))
    order = Window.partitionBy("row").orderBy("pos")
    gone = gone.select("id", "row", "pos", "start", "stop", F.col("first.b").alias("first_id"))
    gone = gone.withColumn("new", (F.col("pos") - F.lag("pos", 1, -width - 1).over(order) > width).cast("int")).withColumn("passage", F.sum("new").over(order))
    made = gone.groupBy("row", "passage").agg(
        F.first("id").alias("id"), F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"),
        (F.max("pos") - F.min("pos") + width).alias("words"), F.min_by("first_id", "pos").alias("first_id"),
    )
    return made.select(F.col("id").alias(id_col), "row", (F.col("passage") - 1).cast("int").alias("passage_no"), "start", "stop", "words", "first_id")
