"""Best-fit packing with conflicts.

Bins are ordered by residual and carry bitmaps of the sources and duplicate clusters inside. A document goes to the bin
with the smallest residual that holds it and has neither; the successor search goes on from residual to residual until
there is one, else a bin is opened.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import SPACE, stored, word_count

#: Equal rows that are numbered in one go.
BLOCK = 4096
_PACKED = "id long, row long, copy long, piece int, size long, source string, cluster long, shard long, bin long, residual long"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, residual after it) for each (size, source bit, cluster bit or -1); sizes are 0 to ``capacity``.

    A bin holds one document of a source and one of a cluster at most. Bins of equal residual and bitmaps are one list,
    and each source keeps a bitmap of the residuals at which all bins hold it, so that the search skips those at once.
    """
    shelves: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(dict)  # residual -> (sources, clusters) -> bins
    present = 0  # bit r: some bin has residual r
    have: dict[tuple[int, int], int] = defaultdict(int)  # (residual, source) -> bins with that source
    count: dict[int, int] = defaultdict(int)
    full: dict[int, int] = defaultdict(int)  # source -> residuals at which all bins hold it
    out, bins = [], 0

    def bits(x: int):
        while x:
            low = x & -x
            yield low.bit_length() - 1
            x ^= low

    def settle(r: int, sources: int) -> None:
        nonlocal present
        present = present | 1 << r if count[r] else present & ~(1 << r)
        for s in bits(sources):
            full[s] = full[s] | 1 << r if count[r] and have[r, s] == count[r] else full[s] & ~(1 << r)

    def all_sources(r: int) -> int:
        x = 0
        for (sources, _), _bins in shelves[r].items():
            x |= sources
        return x

    for size, source, cluster in items:
        mask = 0 if cluster < 0 else 1 << cluster
        left = (present & ~full[source]) >> size << size
        place = None
        while left and place is None:
            r = (left & -left).bit_length() - 1
            left &= left - 1
            place = next(((r, k) for k in shelves[r] if not k[0] >> source & 1 and not k[1] & mask), None)
        if place:
            r, k = place
            number = shelves[r][k].pop()
            seen = all_sources(r)
            if not shelves[r][k]:
                del shelves[r][k]
            count[r] -= 1
            for s in bits(k[0]):
                have[r, s] -= 1
            settle(r, seen)
        else:
            r, k, number = capacity, (0, 0), bins
            bins += 1
        rest, k = r - size, (k[0] | 1 << source, k[1] | mask)
        shelves[rest].setdefault(k, []).append(number)
        count[rest] += 1
        for s in bits(k[0]):
            have[rest, s] += 1
        settle(rest, all_sources(rest))
        out.append((number, rest))
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 2048, shard_docs: int = 4000, cluster_col: str | None = None
) -> DataFrame:
    """One row per piece: id, copy, piece, start_word, size, source, cluster, shard, bin, residual.

    Sizes are words. A text of more than ``capacity`` words, however long, is cut into pieces of ``capacity`` and a rest,
    none of them dropped; a text without words (or null) has one piece of size 0 and no bin. Documents are dealt to
    shards of about ``shard_docs`` by hash, and each shard is packed by itself, largest pieces first, then by id, so a
    shard's memory is bounded and the number of tasks follows the input. ``bin`` is numbered within the shard. In a bin
    no two pieces have the same source (null is one) or the same duplicate cluster: ``cluster_col`` (null: in none), or
    else a hash of the text without case and white space, so that exact copies are kept apart.

    What decides is content only (id, text, source, cluster), so the bins do not depend on files or partitions. Rows
    that repeat all of it are documents of their own, numbered by ``copy``. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.xxhash64(F.lower(F.regexp_replace(text, SPACE + "+", "")))
    light = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("words"), cluster.alias("cluster")
    )
    alike = ["id", "row", "source", "words", "cluster"]
    # equal rows are counted and numbered, in blocks that are dealt out anew, so that many of them are no single task
    counts = stored(light.groupBy(*alike).agg(F.count("*").alias("n")), "documents")
    shards = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // shard_docs))
    blocks = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block")).repartition("row", "block")
    copies = blocks.select(*alike, F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1)).alias("copy"))
    whole = F.floor(F.greatest(F.col("words") - 1, F.lit(0)) / capacity)
    pieces = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("piece")).select(
        "id", "row", "copy", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("long").alias("size"),
        "source", "cluster", F.pmod(F.xxhash64(*alike, "copy"), F.lit(shards)).alias("shard"),
    )

    def one(shard: pa.Table) -> pa.Table:
        # Arrow, not pandas, which would make doubles of ids and clusters where some are null
        shard = shard.sort_by([("size", "descending"), *[(c, "ascending") for c in ("id", "row", "source", "cluster", "copy", "piece")]])
        of, groups = shard["source"].to_pylist(), shard["cluster"].to_pylist()
        sources = {s: k for k, s in enumerate(dict.fromkeys(of))}
        # only clusters of two pieces or more can be in conflict, and have a bit
        met = Counter(c for c in groups if c is not None)
        clusters = {c: k for k, c in enumerate(c for c, n in met.items() if n > 1)}
        placed = best_fit([(n, sources[s], clusters.get(c, -1)) for n, s, c in zip(shard["size"].to_pylist(), of, groups, strict=True)], capacity)
        for name, k in (("bin", 0), ("residual", 1)):
            shard = shard.append_column(name, pa.array([p[k] for p in placed], pa.int64()))
        return shard

    pieces = stored(pieces, "pieces")
    empty = pieces.filter("size = 0").select("*", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("residual"))
    packed = pieces.filter("size > 0").groupBy("shard").applyInArrow(one, _PACKED).select(*empty.columns).union(empty)
    return packed.select(
        F.col("id").alias(id_col), "copy", "piece", (F.col("piece").cast("long") * capacity).alias("start_word"), "size", F.col("source").alias(source_col), "cluster", "shard", "bin", "residual"
    )
