"""What the training-data operators share: stored intermediates, bounded filters, batch text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.storage import scratch, shared_dir, stored

__all__ = ["SPACE", "WORD", "cut_spans", "key_filter", "keyed", "may_hold", "mix64", "read", "row_key", "scratch", "shared_dir", "shingle_sets", "small_batches", "stored", "word_count", "word_hashes"]

#: Word separators of every operator here: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Has Spark send Python workers so many rows and bytes at a time at most, so that their memory follows a few texts and not a partition."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): ``row`` is a hash of both, the same however often and from whatever files the table is read; rows that repeat both share it."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", row_key(F.col("id"), F.col("text")).alias("row"), "text")


def row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(key.isNull(), F.coalesce(key, F.lit(0).cast("long")), text.isNull(), F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null; counts the starts of words without making an array."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, kept: str = "kept_spans") -> DataFrame:
    """``docs`` without the code points of ``spans`` (row, start, stop), with ``kept``: the offsets in the original text of what stays.

    ``row`` is that of ``keyed``, so rows that share an id and have other texts are cut by themselves, also those without
    an id. A character after a span (a line end, mostly) goes with it, and what stays is joined by line ends. A column of
    ``docs`` that is called as ``kept`` is replaced; all others stay.
    """
    by_text = spans.groupBy(F.col("row").alias("_cut_row")).agg(F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("_cuts"))
    docs = docs.withColumn("_row", row_key(F.col(id_col).cast("long"), F.col(text_col)))
    last = F.struct((F.length(text_col).cast("long") + 1).alias("start"), F.lit(0).cast("long").alias("stop"))
    gaps = F.transform(
        F.concat("_cuts", F.array(last)),
        lambda c, k: F.struct(F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get("_cuts", k - 1)["stop"] + 1).alias("start"), (c["start"] - 1).alias("stop")),
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(text_col).cast("long").alias("stop")))
    return (
        docs.join(by_text, F.col("_row") == F.col("_cut_row"), "left")
        .withColumn(kept, F.when(F.col("_cuts").isNull(), whole).otherwise(F.filter(gaps, lambda g: g["start"] <= g["stop"])))
        .withColumn(
            text_col,
            F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(
                F.array_join(F.transform(kept, lambda g: F.substring(F.col(text_col), (g["start"] + 1).cast("int"), (g["stop"] - g["start"]).cast("int"))), "\n")
            ),
        )
        .drop("_cuts", "_row", "_cut_row")
    )


# --- a filter of fixed size ---------------------------------------------------------------------------------------
#: A key sets one bit of at most 2**MAX_BITS, held as 64-bit words: at most 2**(MAX_BITS-6) rows of 16 bytes (2 MB), whatever the input.
MAX_BITS = 23


def _bit(key: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(1 << MAX_BITS))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")


def key_filter(keys: DataFrame, key: Column) -> DataFrame:
    """Rows (slot, bits), at most 2**(MAX_BITS - 6) of them, that mark each ``key``; other keys can share a bit, so what passes is a superset."""
    slot, bit = _bit(key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return keys.select(slot.alias("slot"), one.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def may_hold(df: DataFrame, key: Column, marks: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean ``out``: false only if ``key`` is not in ``marks``. ``marks`` has a proven size and is broadcast."""
    slot, bit = _bit(key)
    return (
        df.withColumn("_slot", slot)
        .join(F.broadcast(marks.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits"))), "_slot", "left")
        .withColumn(out, F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False)))
        .drop("_slot", "_bits")
    )


# --- word and shingle hashes of whole batches of texts ------------------------------------------------------------
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_STEP = [np.uint64(pow(0xD1342543DE82EF95, j, 1 << 64)) for j in range(8)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=total[1:])
    words = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bound = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(start, bound), prepend=0)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Of each text its set of hashes of ``width`` words in a row, sorted; the whole sequence as one if it has fewer; empty without words."""
    for lo, hi in _batches(texts):
        words, counts = word_hashes(texts[lo:hi])
        n = len(words) - width + 1
        grams = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(width):
            if n > 0:
                grams += words[j : n + j] * _STEP[j]
        grams = mix64(grams)
        at = 0
        for c in counts:
            if c >= width:
                yield np.unique(grams[at : at + c - width + 1])
            elif c:
                whole = sum(int(w) * int(_STEP[j]) for j, w in enumerate(words[at : at + c])) + 0x5851F42D4C957F2D * int(width - c)
                yield mix64(np.array([whole & (1 << 64) - 1], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += c


def _batches(texts: list[bytes], most: int = 1 << 18):
    """Ranges of texts of about ``most`` bytes, so that memory follows the longest text and not the batch."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
