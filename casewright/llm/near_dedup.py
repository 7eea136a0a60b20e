"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Signatures take two permutations only: the first scatters the shingles over 2**32 places, the second, a bijection of
32-bit words, is shifted circularly by 0, 1, 2, ... to give all coordinates. Texts with equal shingle sets are one
class, so copies cost one signature and no pairs. Classes that share a band meet in buckets; equal buckets of several
bands are looked into once. A large bucket is cut into blocks of bounded size, each of which is first compared with one
block of it only, so a hot bucket is spread over many tasks and its texts are sent once. What that links is in one
component, and needs no more comparing inside it; members outside a bucket's largest component are then compared with
all of it, block by block, so that no link is lost. In a cell the full sets decide. Links leave a cell as a spanning
forest, never as all pairs, and components of the links make the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import key_filter, may_hold, mix64, shingle_sets, small_batches, stored
from casewright.operators.graph import components

#: Coordinates of a band, bands. Two sets of similarity 0.85 share none of 25 bands of 5 with a probability of 4e-7.
BANDING = (5, 25)
#: For a similarity of 0.8: 5e-8.
BANDING_80 = (4, 32)
#: Members and shingles of a block, about; a cell has two blocks at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Nodes that one spanning forest of links holds at most.
FOREST = 1_000_000
_SIGNED = "id long, row long, n_shingles long, set1 long, set2 long, bands array<long>"


def _scatter(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit words."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` coordinates of the circulant MinHash of a set of shingle hashes."""
    first = (mix64(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    shift = np.arange(n, dtype=np.uint32)[:, None]
    for lo in range(0, len(first), 4096):  # bounded memory for long texts
        np.minimum(out, _scatter(first[None, lo : lo + 4096] - shift).min(axis=1), out=out)
    return out


def bands(shingles: np.ndarray, rows: int, n: int) -> np.ndarray:
    """A 64-bit key for each of ``n`` bands of ``rows`` coordinates."""
    sig = signature(shingles, rows * n).reshape(n, rows).astype(np.uint64)
    key = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = mix64(key ^ sig[:, j])
    return key.view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def _sign(banding: tuple[int, int]):
    def summary(s: np.ndarray) -> tuple:
        if not len(s):
            return 0, 0, 0, s.view(np.int64)
        one, two = mix64(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + np.uint64(0x89ABCDEF)))
        return len(s), int(one.view(np.int64)), int(two.view(np.int64)), bands(s, *banding)

    def signed(batches):
        for batch in batches:
            n, one, two, keys = zip(*(summary(s) for s in shingle_sets(_texts(batch.column(2)))), strict=True) if batch.num_rows else ((), (), (), ())
            columns = [pa.array(c, pa.int64()) for c in (n, one, two)] + [pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "row", "n_shingles", "set1", "set2", "bands"])

    return signed


def forest(sets: list[np.ndarray], left: int, percent: int) -> list[tuple[int, int]]:
    """Links between the first ``left`` sets and the rest (all, if there is no rest) that connect what the full sets link."""
    n = len(sets)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(len(ids), dtype=bool)
    out = []
    for x in range(n if left == n else left):
        lo = x + 1 if left == n else left
        if lo >= n:
            break
        mine = flat[start[x] : start[x + 1]]
        held[mine] = True
        common = np.add.reduceat(held[flat[start[lo] :]].astype(np.int64), start[lo:n] - start[lo])
        held[mine] = False
        union = sizes[x] + sizes[lo:] - common
        for y in np.flatnonzero(100 * common >= percent * union) + lo:
            a, b = root(x), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, int(y)))
    return out


def _verify(percent: int):
    def cells(batches):
        key, members = None, []

        def done() -> list[tuple[int, int]]:
            sets = shingle_sets([text for _, _, text in members])
            full = [(i, side, s) for (i, side, _), s in zip(members, sets, strict=True) if len(s)]
            if len(full) < 2:
                return []
            return [(full[x][0], full[y][0]) for x, y in forest([s for _, _, s in full], sum(side == 0 for _, side, _ in full), percent)]

        for batch in batches:
            links: list[tuple[int, int]] = []
            for cell, side, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _texts(batch.column(3)), strict=True):
                if cell != key:
                    links += done()
                    key, members = cell, []
                members.append((i, side, text))
            yield _pairs(links)
        yield _pairs(done())

    return cells


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])


def _forest(batches):
    """Links of a part as stars around the smallest node of each tree, so that what several cells found again and again is said once."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars():
        found = [(r, x) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST:
            yield stars()
            parent.clear()
    yield stars()


def _cells(members: DataFrame) -> DataFrame:
    """(cell, side, rep) of members (key, block, other, rep): what is compared with what, both ways round once."""
    return members.select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), (F.col("block") > F.col("other")).cast("int").alias("side"), "rep"
    )


def _links(cells: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning forests of the links inside the cells, decided by full sets."""
    # only texts of cell members travel: the filter has a fixed size, what it lets through too much the join drops
    marks = stored(key_filter(cells.select("rep"), F.col("rep")), "reps")
    texts = may_hold(base.filter("id is not null"), F.col("id"), marks, "wanted").filter("wanted").select(F.col("id").alias("rep"), "text")
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = cells.join(texts, "rep").select("cell", "side", "rep", "text").repartition(parts, "cell").sortWithinPartitions("cell", "side")
    found = grouped.mapInArrow(_verify(percent), "a long, b long").filter("a != b")
    return stored(found, "pairs")


def _thinned(links: DataFrame) -> DataFrame:
    return links.filter("a != b").mapInArrow(_forest, "a long, b long").distinct()


def _left_over(members: DataFrame, label: DataFrame) -> DataFrame:
    """Cells for what the first cells of large buckets leave open: members of one component are linked already, so those outside a bucket's largest one meet all others."""
    m = stored(members.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")
    largest = m.groupBy("key", "blocks", "component").agg(F.count("*").alias("n")).groupBy("key", "blocks").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    rest = F.ceil((F.col("n") - F.col("top.n")) * F.col("blocks") / F.col("n")).cast("int")
    # a bucket of one component is done
    largest = stored(largest.filter("n > top.n").select("key", F.col("top.component").alias("top"), rest.alias("rest_blocks")), "largest")
    m = m.join(largest, "key").withColumn("rest", F.col("component") != F.col("top"))
    salt = F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("rest_blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
    among = _cells(m.filter("rest").select("key", salt.alias("block"), every(F.col("rest_blocks")), "rep"))
    mine = m.filter("rest").select("key", salt.alias("i"), every(F.col("blocks")), "rep").select(F.xxhash64(F.lit(5), "key", "i", "other").alias("cell"), F.lit(0).alias("side"), "rep")
    theirs = m.filter("not rest").select("key", "block", every(F.col("rest_blocks")), "rep").select(F.xxhash64(F.lit(5), "key", "other", "block").alias("cell"), F.lit(1).alias("side"), "rep")
    return among.union(mine).union(theirs)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, banding: tuple[int, int] = BANDING) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, first_row.

    A text's set is its distinct shingles of five words (A-Z lower-cased); with fewer words the whole sequence as one.
    Texts are linked if 100 * intersection >= percent * union on the full sets. ``component_id`` is the smallest id
    reachable over links, itself included; ``kept`` where it is the own id. Null or empty texts and texts of white
    space only have an empty set and are linked with nothing. Rows that repeat an id are one node; ``first_row`` marks
    one of them. Rows with a null id are never linked: component_id is null, kept true. An empty table gives no rows. A very
    long text is one member as any other; blocks of compared texts are bounded by their shingles too. Other columns,
    whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(base.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "text").mapInArrow(_sign(banding), _SIGNED), "signed")
    known = signed.filter("id is not null and n_shingles > 0")
    same = ["set1", "set2"]
    classes = stored(known.groupBy(*same).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")), "classes")
    entries = classes.select(F.explode("bands").alias("key"), "rep", "n_shingles")
    buckets = (
        entries.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("x2"))
        .filter("n > 1")
        .groupBy("n", "size", "x1", "x2").agg(F.min("key").alias("key"))  # the same members in another band: one bucket
        .select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.least(F.col("n"), F.col("size") / BLOCK_SHINGLES))).cast("int").alias("blocks"))
    )
    members = entries.select("key", "rep").join(stored(buckets, "buckets"), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = stored(members, "members")
    # every block meets the bucket's first one
    others = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    links = _links(_cells(members.select("key", "block", F.explode(others).alias("other"), "rep")), base, percent)
    large = members.filter("blocks > 1")
    if large.limit(1).count():
        links = links.union(_links(_left_over(large, components(_thinned(links))), base, percent))
    # rows that repeat an id with different texts tie their classes together
    ties = known.groupBy("id").agg(F.min(F.struct(*same)).alias("x"), F.max(F.struct(*same)).alias("y")).filter("x != y")
    tied = known.join(ties.select("id"), "id", "left_semi").join(classes.select(*same, "rep"), same).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    label = components(_thinned(links.union(tied)))
    # only classes with a copy or a link need a row of their own; all others are their own component
    moved = classes.join(label.withColumnRenamed("id", "node"), F.col("rep") == F.col("node"), "left").filter("copies > 1 or component is not null").select(*same, F.coalesce("component", "rep").alias("component"))
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    rows = signed.select("id", "row", "n_shingles", F.when(alone, F.col("row")).otherwise(F.col("set1")).alias("set1"), F.when(alone, F.lit(0)).otherwise(F.col("set2")).alias("set2"), alone.alias("alone"))
    rows = rows.join(moved, same, "left").withColumn("component_id", F.coalesce("component", "id"))
    firsts = signed.filter("id is not null").groupBy("id").agg(F.min("row").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    rows = rows.join(firsts, "id", "left")
    return rows.select(
        F.col("id").alias(id_col), "n_shingles", "component_id",
        (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"), (F.col("first").isNull() | (F.col("first") == F.col("row"))).alias("first_row"), "row",
    )
