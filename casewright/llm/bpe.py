"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that no token of the vocabulary has inside can't be inside a token of any text either, so there is always
a cut between them. Texts are split at such pairs into fragments, mostly words, which are encoded by themselves and
put together again. A worker keeps the fragments that it has encoded, so common ones cost a look-up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from casewright.llm.common import small_batches

#: Largest vocabulary file that is sent to the workers, bytes.
MOST_BYTES = 64 << 20
#: Fragments a worker keeps, and bytes of the longest one that is kept.
KEPT, KEPT_BYTES = 1 << 18, 64
#: Bytes of texts that are cut and looked up together.
BLOCK = 1 << 19
# Contractions that byte-level vocabularies of this kind split off before merging.
CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
#: Splits a fragment into words as those vocabularies do (letters, digits, other characters, white space).
_SPLIT = ByteLevel(add_prefix_space=False, use_regex=True)
#: What is one word without a look at tables: Latin letters up to U+023F, with or without a space before.
_LATIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")
#: Bytes that begin or go on with white space beyond ASCII (and some other characters): there is no cut after those.
_WIDE_BLANKS = ((0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))


def _shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if it prints, else one from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


_SHOWN = _shown_bytes()


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """``tokens`` by id; ``merges``: place in the order of merges of each pair of ids (first << 32 | second); ``wholes``: id that each merge makes; ``special``: ids of texts that are tokens as they stand."""

    tokens: tuple[bytes, ...]
    merges: dict[int, int]
    wholes: np.ndarray
    special: dict[bytes, int]

    def __post_init__(self):
        inside = np.zeros((256, 256), dtype=bool)
        ordinary = [t for t in self.tokens if t not in self.special]
        for t in (*ordinary, *CONTRACTIONS):
            b = np.frombuffer(t, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
        text_cut = ~inside
        text_cut[:, 0x80:0xC0] = False  # within a character
        text_cut[:, ord("'")] = False  # what follows could be read as a contraction
        text_cut[[*range(9, 14), *range(28, 33)]] = False  # how white space splits depends on what follows
        alone = {t: k for k, t in enumerate(self.tokens) if len(t) == 1}
        known = {
            "forced": ~inside.ravel(), "text_cut": text_cut.ravel(), "singles": np.array([alone[bytes([b])] for b in range(256)], dtype=np.int32),
            "token_sizes": (sizes := np.array([len(t) for t in self.tokens], dtype=np.int64)), "token_starts": np.cumsum(sizes) - sizes, "token_bytes": np.frombuffer(b"".join(self.tokens), dtype=np.uint8),
            "ends": re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None,
        }
        self.__dict__.update(known)
        self.__dict__.update(zip(("slot_keys", "slot_places"), self._slots(), strict=True))

    def _slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Merges by pair in a table of slots, a fifth of them full or less; a pair is in the first free slot from its own on."""
        size = 1 << max(10, (5 * len(self.merges)).bit_length())
        keys, places = np.full(size, -1, dtype=np.int64), np.full(size, len(self.wholes), dtype=np.int32)
        for key, slot, place in zip(self.merges, _slot(np.array(list(self.merges), dtype=np.int64), size).tolist(), self.merges.values(), strict=True):
            while keys[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            keys[slot], places[slot] = key, place
        return keys, places

    def _places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places in the order of merges of pairs of ids; the number of merges for pairs that are none."""
        key = (first.astype(np.int64) << 32 | second).ravel()
        size = len(self.slot_keys)
        slot = _slot(key, size)
        held = self.slot_keys[slot]
        out = np.where(held == key, self.slot_places[slot], np.int32(len(self.wholes)))
        on = np.flatnonzero((held != key) & (held >= 0))  # another pair is in the slot
        while len(on):
            slot[on] = (slot[on] + 1) & (size - 1)
            held = self.slot_keys[slot[on]]
            hit = held == key[on]
            out[on[hit]] = self.slot_places[slot[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out.reshape(first.shape)

    def merge_short(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of parts of KEPT_BYTES at most: in each round every part makes its earliest merge, the leftmost of equal ones."""
        size = np.array([len(p) for p in parts])
        out: list[bytes] = [b""] * len(parts)
        for low, high in ((0, 8), (8, 12), (12, 20), (20, KEPT_BYTES)):
            of = np.flatnonzero((size > low) & (size <= high))
            for lo in range(0, len(of), 1 << 14):
                rows = of[lo : lo + (1 << 14)]
                packed, ends = self._merged([parts[k] for k in rows], size[rows], high)
                for k, a, b in zip(rows.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    out[k] = packed[a:b]
        return out

    def _merged(self, parts: list[bytes], size: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
        none, columns = np.int32(len(self.wholes)), np.arange(width)
        ids = np.full((len(parts), width + 1), -1, dtype=np.int32)
        ids[:, :width][columns < size[:, None]] = self.singles[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        places = np.where(columns < size[:, None] - 1, self._places(ids[:, :-1], ids[:, 1:]), none)  # of each id with the next one
        done, left = np.full((len(parts), width), -1, dtype=np.int32), np.arange(len(parts))
        while len(left):
            best = places.argmin(axis=1)
            place = places[np.arange(len(left)), best]
            ended = place == none
            if ended.any():
                done[left[ended]] = ids[ended, :width]
                on = ~ended
                left, ids, places, best, place = left[on], ids[on], places[on], best[on], place[on]
            row = np.arange(len(left))
            ids[row, best] = self.wholes[place]
            # what stands behind the second of the two moves up
            ids[:, :width] = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            ids[:, width] = -1
            places[:, :-1] = np.take_along_axis(places, columns[:-1] + (columns[:-1] > best[:, None]), axis=1)
            places[:, -1] = none
            places[row, best] = np.where(ids[row, best + 1] >= 0, self._places(ids[row, best], np.maximum(ids[row, best + 1], 0)), none)
            before = np.flatnonzero(best > 0)
            at = best[before] - 1
            places[before, at] = self._places(ids[before, at], ids[before, at + 1])
        held = done >= 0
        return done[held].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(4 * held.sum(axis=1))])

    def merge_long(self, part: bytes) -> list[int]:
        """Ids of a run of any length, in n log n: pairs in a heap, neighbours in lists of links."""
        ids, n = self.singles[np.frombuffer(part, dtype=np.uint8)].tolist(), len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            place, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = int(self.wholes[place]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := self.merges.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (m, a, ids[a], ids[b]))
        return [k for k in ids if k >= 0]

    def fragments(self, some: list[bytes]) -> list[bytes]:
        """Packed ids of fragments of texts: each is split into words, long words at forced boundaries, and the parts are merged together."""
        parts, ends = [], [0]
        for data in some:
            if len(data) <= KEPT_BYTES and _LATIN.fullmatch(data):
                parts.append(data)
            else:
                for word, _ in _SPLIT.pre_tokenize_str(data.decode()):
                    word = bytes([_SHOWN[c] for c in word])
                    cuts = [0, *(_cuts(word, self.forced).tolist() if len(word) > KEPT_BYTES else ()), len(word)]
                    parts += [word[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
            ends.append(len(parts))
        made = self.merge_short([p if len(p) <= KEPT_BYTES else b"" for p in parts])
        for k, p in enumerate(parts):
            if len(p) > KEPT_BYTES:
                made[k] = np.array(self.merge_long(p), dtype="<u4").tobytes()
        return [made[a] if b == a + 1 else b"".join(made[a:b]) for a, b in zip(ends, ends[1:])]  # noqa: B905

    def encode(self, texts: list[bytes], known: Known) -> list[bytes]:
        """Packed ids of texts in UTF-8. Texts are cut and looked up some BLOCK bytes at a time; fragments that are not known are encoded together."""
        out = [bytearray() for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            ends = np.cumsum([len(p) for _, p in waiting])
            data = b"".join([p for _, p in waiting])
            cut = np.zeros(len(data) + 1, dtype=bool)
            cut[self._text_cuts(data)] = True
            cut[0] = True
            cut[ends] = True
            cuts = np.flatnonzero(cut)
            places = cuts.tolist()
            codes = known.codes([data[lo:hi] for lo, hi in zip(places, places[1:])])  # noqa: B905
            upto = np.searchsorted(cuts, ends).tolist()
            for (k, _), lo, hi in zip(waiting, [0, *upto[:-1]], upto, strict=True):
                out[k] += b"".join(codes[lo:hi])
            waiting.clear()
            held = 0

        for k, text in enumerate(texts):
            for part in self.ends.split(text) if self.ends else (text,):
                if part in self.special:
                    if waiting:
                        flush()
                    out[k] += self.special[part].to_bytes(4, "little")
                    continue
                for piece in self._pieces(part):
                    waiting.append((k, piece))
                    held += len(piece)
                    if held >= BLOCK:
                        flush()
        if waiting:
            flush()
        return [bytes(b) for b in out]

    def _pieces(self, part: bytes):
        """A long text in pieces of some BLOCK bytes that end at cuts, so that a very long one is not all in fragments at once."""
        at, size = 0, BLOCK
        while len(part) - at > size:
            cuts = self._text_cuts(part[at : at + size])
            if len(cuts):
                yield part[at : at + int(cuts[-1])]
                at, size = at + int(cuts[-1]), BLOCK
            else:
                size *= 2
        if at < len(part):
            yield part[at:]

    def _text_cuts(self, data: bytes) -> np.ndarray:
        """Places at which a text can be cut before it is split into words. Bytes of another text in front can only keep a cut from being made."""
        cuts = _cuts(data, self.text_cut)
        if len(cuts) and not data.isascii():
            b = np.frombuffer(data, dtype=np.uint8)
            last, middle, first = b[cuts - 1], b[cuts - 2], b[cuts - 3]
            blank = (middle == 0xC2) & ((last == 0x85) | (last == 0xA0))
            for lead, seconds in _WIDE_BLANKS:
                blank |= (first == lead) & np.isin(middle, seconds)
            cuts = cuts[~blank]
        return cuts

    def decode(self, packed: list[bytes | None]) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts, one after the other, and where each ends; an id that is not in the vocabulary is an error."""
        ids = np.frombuffer(b"".join([p or b"" for p in packed]), dtype="<u4").astype(np.int64)
        if len(ids) and ids.max() >= len(self.tokens):
            raise ValueError("an id is not in the vocabulary")
        size = self.token_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = np.empty(int(ends[-1]), dtype=np.uint8)
        for lo in range(0, len(ids), 1 << 18):  # so that places are held for some tokens only
            hi = min(lo + (1 << 18), len(ids))
            a, b = int(ends[lo]), int(ends[hi])
            data[a:b] = self.token_bytes[np.arange(a, b) + np.repeat(self.token_starts[ids[lo:hi]] - ends[lo:hi], size[lo:hi])]
        return data.tobytes(), ends[np.cumsum([0] + [len(p or b"") // 4 for p in packed])]


def _cuts(part: bytes, table: np.ndarray) -> np.ndarray:
    b = np.frombuffer(part, dtype=np.uint8).astype(np.uint16)
    return np.flatnonzero(table[b[:-1] << np.uint16(8) | b[1:]]) + 1


class Known:
    """Packed ids of fragments that were encoded before, if short. When KEPT are held they become the older ones, from which those still in use come back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.now, self.older = vocabulary, {}, {}

    def codes(self, some: list[bytes]) -> list[bytes]:
        """Packed ids of fragments, in their order."""
        found = list(map(self.now.get, some))
        lacking = [k for k, v in enumerate(found) if v is None]
        if lacking:
            fresh = dict.fromkeys(some[k] for k in lacking)
            new = []
            for f in fresh:
                if (code := self.older.get(f)) is None:
                    new.append(f)
                fresh[f] = code
            fresh.update(zip(new, self.vocabulary.fragments(new), strict=True))
            for k in lacking:
                found[k] = fresh[some[k]]
            if len(self.now) + len(fresh) > KEPT:
                self.now, self.older = {}, self.now
            self.now.update((f, code) for f, code in fresh.items() if len(f) <= KEPT_BYTES)
        return found


def parsed(content: bytes) -> Vocabulary:
    """A vocabulary file (JSON) of a byte-level BPE without normaliser; any other kind is refused."""
    found = json.loads(content)
    model, before = found["model"], found.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or found.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("not a byte-level BPE vocabulary of the kind that is read here")
    special = {}
    tokens = {k: bytes(_SHOWN[c] for c in t) for t, k in model["vocab"].items()}
    for t in found.get("added_tokens", ()):
        if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
            raise ValueError("added tokens that take white space or are normalised are not read here")
        special[t["content"].encode()] = t["id"]
        tokens[t["id"]] = t["content"].encode()
    ids = {t: k for k, t in tokens.items() if t not in special}
    if any(bytes([b]) not in ids for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    merges, wholes = {}, []
    for place, pair in enumerate(model["merges"]):
        a, b = (bytes(_SHOWN[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
        merges.setdefault(ids[a] << 32 | ids[b], place)
        wholes.append(ids[a + b])
    return Vocabulary(tuple(tokens.get(k, b"") for k in range(max(tokens) + 1)), merges, np.array(wholes, dtype=np.int32), special)


_loaded: dict[bytes, tuple[Vocabulary, Known]] = {}


def _of(content: bytes) -> tuple[Vocabulary, Known]:
    """The vocabulary of this worker, read once."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded.clear()
        vocabulary = parsed(content)
        _loaded[key] = vocabulary, Known(vocabulary)
    return _loaded[key]


class Codec:
    """Column functions of one vocabulary file, which the driver reads at ``path`` and sends to the workers (MOST_BYTES at most)."""

    def __init__(self, spark: SparkSession, path: str):
        content = Path(path).read_bytes()
        if len(content) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        parsed(content)  # a file that can't be read is refused here and not in a task
        small_batches(spark)
        self._sent = spark.sparkContext.broadcast(content)

    def encode(self, text: Column) -> Column:
        """Token ids of whole texts as little-endian unsigned 32-bit integers (binary).

        Special tokens in a text are read as such. A null text counts as empty and has no ids; a very long one takes
        memory by its length. Each row is judged by itself, so repeated rows and empty tables need no care.
        """
        sent = self._sent

        @F.arrow_udf("binary")
        def ids(texts: pa.Array) -> pa.Array:
            vocabulary, known = _of(sent.value)
            return pa.array(vocabulary.encode([t or b"" for t in texts.cast(pa.binary()).to_pylist()], known), pa.binary())

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """The text of packed ids, special tokens as they stand; null for null; bytes that are no UTF-8 become U+FFFD. An id that is not in the vocabulary is an error."""
        sent = self._sent

        @F.arrow_udf("string")
        def texts(packed: pa.Array) -> pa.Array:
            data, ends = _of(sent.value)[0].decode(given := packed.to_pylist())
            return pa.array([None if p is None else data[a:b].decode("utf-8", "replace") for p, a, b in zip(given, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())

        return texts(ids)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
