"""Importance resampling towards a target distribution, with features that are hashed runs of words.

Texts that are equal are one group: its features are made once, count as often as the group has documents, and its weight
is reckoned once and joined back to the documents, each of which then adds noise of its own and is ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import small_batches, stored
from casewright.operators.sequences import ranked

#: Buckets of features, words in the longest feature, bytes of the longest word whose features are made by table.
BUCKETS, LONGEST, SHORT = 10_000, 3, 64
_FEATURES = "key binary, n long, n_features long, buckets array<smallint>, counts array<int>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BYTE_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)  # of a remainder's low byte, moved by a byte


def _shift_tables(most: int) -> np.ndarray:
    """[n, k, b]: what byte k of a remainder, equal to b, becomes when n more bytes follow."""
    out = np.zeros((most + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, most + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ _BYTE_STEP[out[n - 1] & np.uint32(255)]
    return out


_SHIFT = _shift_tables(SHORT + 1)


def _followed(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other, from those of both and the length of the second, of SHORT + 1 at most."""
    b = np.uint32(255)
    moved = _SHIFT[length, 0, crc & b] ^ _SHIFT[length, 1, crc >> np.uint32(8) & b] ^ _SHIFT[length, 2, crc >> np.uint32(16) & b] ^ _SHIFT[length, 3, crc >> np.uint32(24)]
    return moved ^ tail


def _word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte for all words at once."""
    state = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    live = np.flatnonzero(length <= SHORT)
    for k in range(SHORT):
        live = live[length[live] > k]
        if not len(live):
            break
        now = state[live]
        state[live] = (now >> np.uint32(8)) ^ _BYTE_STEP[(now ^ data[start[live] + k]) & np.uint32(255)]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT):
        state[i] = zlib.crc32(data[start[i] : start[i] + length[i]])
    return state


def feature_crcs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of every feature of the texts: the words, and the runs of up to LONGEST words joined by a space; A-Z are lower-cased."""
    data = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(_IN_WORD[data], prepend=False, append=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    crc = run = _word_crcs(data, start, length)
    short = np.minimum(length, SHORT)
    spaced = _followed(np.full(len(run), zlib.crc32(b" "), dtype=np.uint32), crc, short)  # of a space and the word
    owners, kept = [of], [crc]
    for n in range(1, min(LONGEST, len(start))):
        shorter, same = run[: len(start) - n], of[: len(start) - n] == of[n:]
        run = _followed(shorter, spaced[n:], short[n:] + 1)
        for i in np.flatnonzero(same & (length[n:] > SHORT)):  # words too long for the tables
            at = start[n + i]
            run[i] = zlib.crc32(b" " + data[at : at + length[n + i]].tobytes(), int(shorter[i]))
        owners.append(of[: len(run)][same])
        kept.append(run[same])
    return np.concatenate(owners), np.concatenate(kept)


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts, 64 and some 256 KB at most, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (size + len(t) > 1 << 18 or i - lo == 64):
            yield texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield texts[lo:]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        sizes, buckets, counts = [], [], []
        for block in _blocks(texts):
            of, crc = feature_crcs(block)
            found = np.bincount(of * BUCKETS + crc % np.uint32(BUCKETS), minlength=len(block) * BUCKETS)
            held = np.flatnonzero(found)
            sizes.append(np.bincount(held // BUCKETS, minlength=len(block)))
            buckets.append((held % BUCKETS).astype(np.int16))
            counts.append(found[held].astype(np.int32))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, dtype=np.int64)
        flat, times = (np.concatenate(x) if x else np.zeros(0) for x in (buckets, counts))
        upto = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((flat, pa.int16()), (times, pa.int32()))]
        keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64()), *lists], ["key", "n", "n_features", "buckets", "counts"])


def text_features(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, n, n_features, buckets, counts) of each distinct text: its SHA-256, how many documents have it, and its features by bucket.

    Texts are grouped whole, null as empty; copies meet in each task first, so a text that a third of all rows have is one row a task.
    """
    small_batches(docs.sparkSession)
    groups = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return groups.select("text", "n").mapInArrow(_featured, _FEATURES)


def bucket_counts(features: DataFrame) -> list[int]:
    """Features in each bucket, a text's as often as documents have it. A task gives a row for each bucket, at most BUCKETS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            own, lists = batch.column(0).to_numpy(), batch.column(1)
            times = np.repeat(own, np.diff(lists.offsets.to_numpy()))
            np.add.at(total, lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy() * times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    found = features.select("n", "buckets", "counts").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * BUCKETS
    for r in found.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds to a weight: thousandths of the logarithm of its smoothed shares in target and source."""
    s_all, t_all = sum(source) + BUCKETS, sum(target) + BUCKETS
    return [math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(source, target, strict=True)]


def text_weights(features: DataFrame, gain: list[int]) -> DataFrame:
    """(key, n_features, weight) of each distinct text: the sum of the gains of its features."""
    sent = features.sparkSession.sparkContext.broadcast(np.array(gain, dtype=np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            each = sent.value[lists.flatten().to_numpy()] * batch.column(3).flatten().to_numpy()
            upto = np.concatenate([[0], np.cumsum(each)])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())], ["key", "n_features", "weight"])

    return features.select("key", "n_features", "buckets", "counts").mapInArrow(weigh, "key binary, n_features long, weight long")


def noise(key: Column, seed: int = 42) -> Column:
    """Thousandths of a Gumbel variable that follows from seed and id."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "utf-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank): every document, with its place among the drawn ones (null: not drawn).

    Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII in the whole text; features
    are all runs of one to three words. Of the documents of ``least_words`` words or more, ``percent`` in a hundred are
    drawn: those with the highest score, then the smallest id (null last), then the smallest hash of the text. A null
    text, or one without words, has no features, weight 0, and is never drawn. Documents that share an id share the
    noise; a null id counts as empty in it. Rows that repeat id and text are rows of their own with equal scores. A very
    long text takes memory by its own length. Without documents there are no rows; without target texts every bucket's
    target count is 0. Other columns, whatever their names, are not read.
    """
    features = stored(text_features(docs, text_col), "features")
    gain = gains(bucket_counts(features), bucket_counts(text_features(target, target_col)))
    weights = stored(text_weights(features, gain), "weights")
    # the weights are a stored table with one row a text, so a text that very many documents share can be split in the join
    each = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8"), 256)).alias("key"))
    scored = each.join(weights, "key").select("id", "key", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    scored = stored(scored, "scored")
    large = F.col("n_features") >= least_features(least_words)
    draw = scored.filter(large).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("key")]
    placed = ranked(scored.filter(large), order, "rank").select("id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank"))
    rest = scored.filter(~large).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.unionByName(rest).withColumnRenamed("id", id_col)


def least_features(words: int) -> int:
    """Features of a text of so many words: no text of fewer words has as many."""
    return sum(max(0, words - k) for k in range(LONGEST))
