"""Audit chains: each entry holds the hash of the one before, so an entry that is altered or taken out shows."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash before the first entry.
GENESIS = "0" * 64
_ENTRY = "chain string, seq long, said string, prev_hash string, hash string"


def entry_hash(seq: Column, said: Column, prev_hash: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\n", seq.cast("string"), F.coalesce(said, F.lit("")), prev_hash), "utf-8"), 256)


def appended(rows: DataFrame, chain: str, order: list[str], said: str, tails: DataFrame | None = None) -> DataFrame:
    """(chain, seq, said, prev_hash, hash): rows as entries of their chain, in order, after its tail (chain, seq, hash) or from the start.

    A hash needs the one before, so a chain's new entries are hashed one after the other in one task: what that bounds is
    the rows of one chain that are appended at once. Null texts count as empty, null chains as "".
    """
    base = rows.select(F.coalesce(F.col(chain).cast("string"), F.lit("")).alias("chain"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.coalesce(F.col(said).cast("string"), F.lit("")).alias("said"))
    if tails is None:
        base = base.withColumns({"seq": F.lit(0).cast("long"), "hash": F.lit(GENESIS)})
    else:
        base = base.join(tails.select("chain", "seq", "hash"), "chain", "left").withColumns({"seq": F.coalesce("seq", F.lit(0)), "hash": F.coalesce("hash", F.lit(GENESIS))})
    by = [f"o{k}" for k in range(len(order))]

    def fold(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(by, kind="stable")
        seq, last, out = int(some["seq"].iloc[0]), some["hash"].iloc[0], []
        for text in some["said"]:
            seq += 1
            now = hashlib.sha256(f"{seq}\n{text}\n{last}".encode()).hexdigest()
            out.append((seq, text, last, now))
            last = now
        made = pd.DataFrame(out, columns=["seq", "said", "prev_hash", "hash"])
        made.insert(0, "chain", some["chain"].iloc[0])
        return made

    return base.groupBy("chain").applyInPandas(fold, _ENTRY)


def breaks(entries: DataFrame) -> DataFrame:
    """(chain, seq, reason) of every entry that does not fit: the one before is altered or missing, or its own hash is wrong.

    Each entry meets the one before by its number, so one long chain is checked by many tasks.
    """
    before = entries.select("chain", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    own = entries.join(before, ["chain", "seq"], "left").withColumn("_before", F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col("_before")))
    reason = F.when(~F.col("prev_hash").eqNullSafe(F.col("_before")), "previous").when(~F.col("hash").eqNullSafe(entry_hash(F.col("seq"), F.col("said"), F.col("prev_hash"))), "entry")
    return own.select("chain", "seq", reason.alias("reason")).filter("reason is not null")


def verified(entries: DataFrame) -> DataFrame:
    """(chain, entries, intact, first_break, reason): each chain and where it breaks first (null: nowhere). Entries missing at its end can't be seen without its tail."""
    first = breaks(entries).groupBy("chain").agg(F.min(F.struct("seq", "reason")).alias("b"))
    return entries.groupBy("chain").agg(F.count("*").alias("entries")).join(first, "chain", "left").select("chain", "entries", F.col("b").isNull().alias("intact"), F.col("b.seq").alias("first_break"), F.col("b.reason").alias("reason"))
