"""Line deduplication: maximal repeated runs of lines, or content-defined chunks of lines.

``repeated_runs`` takes every two neighbouring lines as a unit, so that a run shared by two texts is found wherever it
starts and ends: a run of two lines or more stands earlier only if each two neighbours in it do. ``repeated_chunks`` is coarser and sends less: a rolling hash over the last lines sets chunk boundaries, and
whole chunks are compared. In both, bytes are compared with those of the first occurrence.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import WORD, cut_spans, key_filter, keyed, may_hold, small_batches, stored

_CHUNK = "id long, row long, chunk_no int, start long, stop long, first_line int, lines int, digest long"
_MASK = (1 << 64) - 1


def chunks(lines: list[str], least: int = 2, most: int = 16, one_in: int = 4) -> list[tuple[int, int, int]]:
    """(first line, line after the last, digest): a boundary after the line at which the rolling hash over the last ``least`` line hashes is 0 modulo ``one_in``."""
    out, first, window = [], 0, [0] * least
    digest = 0
    for k, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        digest = ((digest ^ h) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
        digest ^= digest >> 29
        window = [*window[1:], h]
        roll = 0
        for x in window:
            roll = (roll * 0xD1342543DE82EF95 + x) & _MASK
        n = k + 1 - first
        if n >= most or n >= least and (roll >> 40) % one_in == 0:
            out.append((first, k + 1, digest))
            first, digest = k + 1, 0
    if first < len(lines):
        out.append((first, len(lines), digest))
    return out


def _cut(least: int, most: int, one_in: int, with_text: bool):
    def cut(batches):
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(9))
            for key, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = (text or "").split("\n")
                at = [0]
                for line in lines:
                    at.append(at[-1] + len(line) + 1)
                for no, (a, b, digest) in enumerate(chunks(lines, least, most, one_in)):
                    if b - a >= least and at[b] - at[a] > b - a:  # several lines, not all empty
                        span = (key, row, no, at[a], at[b] - 1, a, b - a, digest - (1 << 64) if digest >> 63 else digest, text[at[a] : at[b] - 1] if with_text else None)
                        for c, v in zip(cols, span, strict=True):
                            c.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            n = 8 + with_text
            names = ["id", "row", "chunk_no", "start", "stop", "first_line", "lines", "digest", "chunk"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, types, strict=True))[:n]], names=names[:n])

    return cut


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, most: int = 16, one_in: int = 4) -> DataFrame:
    """One row per chunk to remove: id, row, chunk_no, start, stop (code points, stop not included), first_line, lines, digest, first_id, first_chunk, copies.

    A chunk has ``least`` to ``most`` lines, about ``one_in`` + ``least`` on average; the rest at the end of a text, if
    shorter than ``least``, is no chunk. Of equal chunks the first stays, in the order of id (null last), text, place.
    Chunks whose bytes differ from the first one of the same digest stay. Null and empty texts have no chunks. ``row``
    is a hash of id and text; rows that repeat both count as one document, whose chunks come once for each of them.
    Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    counted = base.mapInArrow(_cut(least, most, one_in, False), _CHUNK).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    marks = stored(key_filter(counted, F.col("digest")), "digests")
    # the second pass sends the text of chunks that repeat only
    found = may_hold(base.mapInArrow(_cut(least, most, one_in, True), _CHUNK + ", chunk string"), F.col("digest"), marks, "again").filter("again").drop("again")
    found = stored(found, "chunks")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"), F.col("chunk_no").alias("d"), F.col("chunk").alias("e"))
    keepers = stored(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "first")
    return (
        found.join(keepers, "digest")
        .filter(((F.col("row") != F.col("first.c")) | (F.col("chunk_no") != F.col("first.d"))) & (F.col("chunk") == F.col("first.e")))
        .select(F.col("id").alias(id_col), "row", "chunk_no", "start", "stop", "first_line", "lines", "digest", F.col("first.b").alias("first_id"), F.col("first.d").alias("first_chunk"), "copies")
    )


_PAIR = "id long, row long, line int, start long, stop long, digest long"
_MULTIPLY = 0x9E3779B97F4A7C15


def _pairs(with_text: bool):
    def pair(batches):
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(7))
            for key, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not text or "\n" not in text:
                    continue
                last, at, middle = None, 0, 0
                for k, line in enumerate(text.split("\n")):
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
                    stop = middle + len(line)
                    if last is not None:
                        digest = ((last * _MULTIPLY + h) ^ (last >> 31)) & _MASK
                        span = (key, row, k - 1, at, stop, digest - (1 << 64) if digest >> 63 else digest, text[at:stop] if with_text else None)
                        for c, v in zip(cols, span, strict=True):
                            c.append(v)
                    last, at, middle = h, middle, stop + 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            n = 6 + with_text
            names = ["id", "row", "line", "start", "stop", "digest", "pair"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, types, strict=True))[:n]], names=names[:n])

    return pair


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal run of lines to remove: id, row, run_no, start, stop (code points, stop not included), first_line, lines, first_id, first_at, copies.

    A line goes if it and a neighbour stand side by side earlier, in the order of id (null last), row, place, without
    sharing a line with that earlier place; lines that go and follow each other are one run. Runs of nothing but empty
    lines stay. ``first_id``, ``first_at`` (a line number) and ``copies`` are of the run's first two lines; a run can be
    put together from several earlier places. ``row`` is a hash of id and text; rows that repeat both count as one document,
    of which the runs are given once. Null and empty texts and an empty table have no runs; very long texts are lines like
    others. Only pairs that repeat are sent with their bytes. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    counted = base.mapInArrow(_pairs(False), _PAIR).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    marks = stored(key_filter(counted, F.col("digest")), "digests")
    found = may_hold(base.mapInArrow(_pairs(True), _PAIR + ", pair string"), F.col("digest"), marks, "again").filter("again").drop("again")
    found = stored(found, "pairs")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"), F.col("line").alias("d"), F.col("pair").alias("e"))
    # the bytes of the first one come with it; stored, so that both sides of the join are plain exchanges and hot lines can be split
    keepers = stored(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "first")
    again = (
        found.join(keepers, "digest")
        .filter(((F.col("row") != F.col("first.c")) | (F.col("line") > F.col("first.d") + 1)) & (F.col("pair") == F.col("first.e")))
        .select("id", "row", "line", "start", "stop", F.col("first.b").alias("first_id"), F.col("first.d").alias("first_at"), "copies")
    )
    order = Window.partitionBy("row").orderBy("line")
    runs = again.withColumn("new", (F.col("line") - F.lag("line", 1, -9).over(order) > 2).cast("int")).withColumn("run", F.sum("new").over(order))
    head = lambda c: F.min_by(c, "line").alias(c)
    made = runs.groupBy("row", "run").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("line").alias("first_line"), (F.max("line") - F.min("line") + 2).alias("lines"),
        head("first_id"), head("first_at"), head("copies"), F.max(F.col("stop") - F.col("start")).alias("most"),
    )
    return made.filter("most > 1").select(F.col("id").alias(id_col), "row", (F.col("run") - 1).cast("int").alias("run_no"), "start", "stop", "first_line", "lines", "first_id", "first_at", "copies")


def remove_chunks(docs: DataFrame, cuts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the chunks or runs of ``cuts``, and without rows of which only white space is left; rows are told apart by id and text, also those without an id. All columns stay."""
    out = cut_spans(docs.withColumn("_chars", F.length(text_col)), cuts, id_col, text_col, "_kept")
    emptied = (F.length(text_col) < F.col("_chars")) & ~F.col(text_col).rlike(WORD)
    return out.filter(~F.coalesce(emptied, F.lit(False))).drop("_chars", "_kept")
