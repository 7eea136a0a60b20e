"""Substring deduplication: normalised units are hashed, grouped globally, and all but the earliest are cut.

Units are lines (``repeated_units``) or runs of words chosen by their content (``repeated_stretches``). Passages are pasted
into the middle of lines and wrapped anew, so lines, paragraphs, sentences and clauses of two copies are not the same;
runs chosen by content are, wherever the copy stands.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import _batches, cut_spans, keyed, mix64, small_batches, stored, word_hashes
from casewright.llm.passage_dedup import as_bytes, code_points, windows

_UNITS = "id long, row long, unit_no int, start long, stop long, digest binary"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal(line: str) -> bytes:
    """A-Z in lower case, words joined by single spaces, no space at either end."""
    return b" ".join(line.encode("utf-8", "surrogatepass").translate(_LOWER).split())


def units(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for key, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                at = 0
                for k, line in enumerate((text or "").split("\n")):
                    # a line of n words has n - 1 blanks or more
                    if len(line) >= 2 * least_words - 1 and (unit := normal(line)).count(b" ") >= least_words - 1:
                        for c, v in zip(cols, (key, row, k, at, at + len(line), md5(unit).digest()), strict=True):
                            c.append(v)
                    at += len(line) + 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "row", "unit_no", "start", "stop", "digest"])

    return keyed(docs, id_col, text_col).mapInArrow(cut, _UNITS)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20) -> DataFrame:
    """One row per unit to cut: id, row, unit_no, start, stop (code points of the original text, stop not included), digest, first_id, first_unit, group_size.

    A unit is a line of ``least_words`` words or more; two are equal if they are equal in lower-cased ASCII and with
    white space squeezed. Of equal units the earliest stays, in the order of id (null last), then row, then place in
    the text; the rest are rows here, also those within one document. ``row`` is a hash of id and text; rows that repeat
    both count as one document, whose units come once for each of them. Null or empty texts have no units, an empty table
    no rows; very long texts are cut into lines like others. Only digests are shuffled, and groups are aggregated, never
    gathered. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    found = stored(units(docs, id_col, text_col, least_words), "units")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"), F.col("unit_no").alias("d"))
    first = stored(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("group_size")).filter("group_size > 1"), "first")
    return (
        found.join(first, "digest")
        .filter((F.col("row") != F.col("first.c")) | (F.col("unit_no") != F.col("first.d")))
        .select(F.col("id").alias(id_col), "row", "unit_no", "start", "stop", F.lower(F.hex("digest")).alias("digest"), F.col("first.b").alias("first_id"), F.col("first.d").alias("first_unit"), "group_size")
    )


def cut_units(docs: DataFrame, cuts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the spans of ``cuts`` (of either kind), with ``kept_spans``: offsets in the original text of what stays (a column of that name is replaced)."""
    return cut_spans(docs, cuts, id_col, text_col)


# --- units of words, chosen by content ----------------------------------------------------------------------------
#: Words of a unit. A run of twice as many words or more always holds a unit that is chosen in both places.
UNIT = 25
#: Words that are looked at beyond either end of a run of repeated units.
REACH = 50
_CHOSEN = "id long, row long, a int, b int, start int, stop int, digest long, check long"
_EDGES = "row long, place long, words array<long>, edges array<int>"


def second_digest(words: np.ndarray, at: np.ndarray, unit: int) -> np.ndarray:
    """Another 64 bits of the units that begin at ``at``, made of the words in another way, so that a unit is known by 128 bits."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(unit):
        out = mix64(out + words[at + j])
    return out


def _chosen(unit: int, reach: int):
    """Units (digest, check, first word a), each once a text, and, without a digest, the stretches of a text that stand earlier in itself."""

    def own_repeats(words, doc, begin, at, first_at):
        """(a, b) of words that units cover which stand ``unit`` words or more earlier in the text, grown at both ends by what is the same there, not into what they repeat."""
        late = np.flatnonzero(at >= first_at + unit)
        if not len(late):
            return []
        r, shift = at[late], (at - first_at)[late]
        edge = np.flatnonzero((np.diff(r) > unit) | np.diff(doc[r]).astype(bool)) + 1
        out = []
        for lo, hi in zip([0, *edge], [*edge, len(r)], strict=True):
            a, b, back, on = int(r[lo]), int(r[hi - 1]) + unit, int(shift[lo]), int(shift[hi - 1])
            size, low, high = b - a, int(begin[a]), int(np.searchsorted(doc, doc[a], side="right"))
            n = min(reach, max(0, back - size), a - back - low)
            same = words[a - n : a] == words[a - n - back : a - back]
            a -= n if same.all() else int(same[::-1].argmin())
            n = min(reach, max(0, on - (b - a)), high - b)
            same = words[b : b + n] == words[b - on : b + n - on]
            b += n if same.all() else int(same.argmin())
            out.append((a, b))
        return out

    def choose(batches):
        for batch in batches:
            ids, rows, texts = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), as_bytes(batch.column(2))
            for lo, hi in _batches(texts):
                if (made := windows(texts[lo:hi], 2 * unit)) is None:
                    continue
                words, doc, begin, parts, _, at = made
                at = np.unique(at)
                _, first, kind = np.unique(mix64(parts[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
                spans = own_repeats(words, doc, begin, at, at[first][kind])
                start, stop = code_points(texts[lo:hi]) if spans else (None, None)
                at = at[np.sort(first)]
                none = [None] * len(at)
                a = np.concatenate([at, np.array([x for x, _ in spans], dtype=at.dtype)])
                columns = (
                    [*(at - begin[at]), *(x - begin[x] for x, _ in spans)], [*none, *(y - begin[x] for x, y in spans)], [*none, *(start[x] for x, _ in spans)],
                    [*none, *(stop[y - 1] for _, y in spans)], *([*d.view(np.int64), *([None] * len(spans))] for d in (parts[at], second_digest(words, at, unit))),
                )
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[a] + lo)), pa.array(rows[lo:hi][doc[a]]), *map(pa.array, columns, types)], names=["id", "row", "a", "b", "start", "stop", "digest", "check"])

    return choose


def _edges(reach: int):
    """Word hashes outwards of each place (twice the word's number, and 1 if the words after it are meant), and the code points at which a cut would end."""

    def look(batches):
        for batch in batches:
            rows, texts, places = batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for lo, hi in _batches(texts):
                words, counts = word_hashes(texts[lo:hi])
                start, stop = code_points(texts[lo:hi])
                first = np.cumsum(counts) - counts
                for k in range(lo, hi):
                    a, n = first[k - lo], counts[k - lo]
                    w, starts, stops = words[a : a + n].view(np.int64), start[a : a + n], stop[a : a + n]
                    for place in places[k]:
                        at = place // 2
                        if place % 2:
                            near, edge = w[at : at + reach], stops[at - 1 : at + reach]
                        else:
                            near, edge = w[max(0, at - reach) : at][::-1], starts[max(0, at - reach) : at + 1][::-1]
                        for c, v in zip(out, (rows[k], place, near, edge), strict=True):
                            c.append(v)
            lists = [pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *lists], names=["row", "place", "words", "edges"])

    return look


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, reach: int = REACH) -> DataFrame:
    """One row per stretch to cut: id, row, stretch_no, start, stop (code points of the original text, stop not included), first_word, words, first_id.

    A unit is a run of ``unit`` words in lower-cased ASCII, whatever white space and line ends are between them; which
    runs are units is decided by their content: of every ``2 * unit`` words in a row the run with the smallest hash.
    Units are grouped by a digest of 128 bits globally and the earliest stays, in the order of id (null last), row, place. A later
    one is cut, with those that follow it in the same order after the same earlier place, and with the words at either
    end that stand there too (up to ``reach``). So every run of ``2 * unit`` words that stands earlier is hit,
    wherever in a line it starts, and nothing shorter than ``unit`` words is cut; a stretch can be put together from
    several earlier places (``first_id`` is that of its first words). A document's repeats of itself are found where it
    is read, and do not reach into what they repeat, so a text of one sentence over and over sends that sentence only.

    ``row`` is a hash of id and text: rows that repeat both are one document, of which the stretches are given once.
    Null, empty and short texts have no units; an empty table has no rows. Very long texts are taken a few at a time,
    and only digests, places and the texts with repeats are sent. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    chosen = stored(base.mapInArrow(_chosen(unit, reach), _CHOSEN), "chosen")
    units = chosen.filter("digest is not null").select("id", "row", F.col("a").alias("pos"), "digest", "check")
    rank = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"), F.col("pos").alias("d"))
    # stored, so that both sides of the join are plain exchanges and a unit of very many documents can be split
    first = stored(units.groupBy("digest", "check").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "check", "first"), "first")
    again = units.join(first, ["digest", "check"]).filter(F.col("row") != F.col("first.c")).select(
        "id", "row", "pos", F.col("first.b").alias("first_id"), F.col("first.c").alias("first_row"), (F.col("pos") - F.col("first.d")).alias("shift")
    )
    order = Window.partitionBy("row").orderBy("pos")
    parts = F.coalesce((F.col("pos") - F.lag("pos").over(order) > unit) | (F.lag("first_row").over(order) != F.col("first_row")) | (F.lag("shift").over(order) != F.col("shift")), F.lit(True))
    runs = again.withColumn("new", parts.cast("int")).withColumn("run", F.sum("new").over(order)).groupBy("row", "run").agg(
        F.first("id").alias("id"), F.first("first_id").alias("first_id"), F.first("first_row").alias("first_row"), F.first("shift").alias("shift"),
        F.min("pos").alias("a"), (F.max("pos") + unit).alias("b"),
    )
    ends = stored(runs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select(
        "*", (2 * F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")).cast("long") + F.col("side")).alias("place")
    ).withColumn("first_place", F.col("place") - 2 * F.col("shift")), "ends")
    places = ends.select("row", "place").union(ends.select("first_row", "first_place")).distinct().groupBy("row").agg(F.collect_list("place").alias("places"))
    seen = base.select("row", "text").join(places, "row").mapInArrow(_edges(reach), _EDGES)
    seen = stored(seen.groupBy("row", "place").agg(F.first("words").alias("words"), F.first("edges").alias("edges")), "edges")
    there = seen.select(F.col("row").alias("first_row"), F.col("place").alias("first_place"), F.col("words").alias("there"))
    differs = F.array_position(F.zip_with("words", "there", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    more = F.when(differs == 0, F.size("words")).otherwise(differs - 1).cast("int")
    held = ends.join(seen, ["row", "place"]).join(there, ["first_row", "first_place"]).withColumn("more", more)
    grown = held.groupBy("row", "run").agg(
        F.first("id").alias("id"), F.first("first_id").alias("first_id"),
        F.max(F.when(F.col("side") == 0, F.col("a") - F.col("more"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("b") + F.col("more"))).alias("b"),
        F.max(F.when(F.col("side") == 0, F.get("edges", "more"))).alias("start"), F.max(F.when(F.col("side") == 1, F.get("edges", "more"))).alias("stop"),
    )
    within = chosen.filter("digest is null").select("row", F.lit(None).cast("long").alias("run"), "id", F.col("id").alias("first_id"), "a", "b", "start", "stop")
    grown = grown.unionByName(within)
    order = Window.partitionBy("row").orderBy("a", "b")
    apart = F.coalesce(F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    made = grown.withColumn("new", apart.cast("int")).withColumn("stretch", F.sum("new").over(order)).groupBy("row", "stretch").agg(
        F.first("id").alias("id"), F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"), F.min("a").alias("first_word"),
        (F.max("b") - F.min("a")).alias("words"), F.min_by("first_id", F.struct("a", "b")).alias("first_id"),
    )
    return made.select(F.col("id").alias(id_col), "row", (F.col("stretch") - 1).cast("int").alias("stretch_no"), "start", "stop", "first_word", "words", "first_id")
