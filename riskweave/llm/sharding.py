"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `virtual` places on a ring of 64-bit hashes; a row belongs to the next
place clockwise from its key's hash. A shard holds a bounded load, and what overflows a
full shard continues clockwise to the next place whose shard has room. Loads are bounded
by the mean itself, the remainder dealt one by one, so counts are at most one apart; a
changed shard count moves only the rows whose place or whose overflow changes.

The ring's arcs are a table of shards x virtual counts, which doesn't grow with the rows.
Overflow is passed on between arcs in rounds; rows then join their arc and their rank in
it with the runs that each shard accepted. Ranks come from counts of salted parts.

Null texts have size 1 and checksum 0; a null doc_id has the hash of null; rows equal in
every column are spread like others; a very long text is one row of its size, only its length
and checksum are taken; other columns, clashing names included, are not read; an empty table
gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, salts, source

VIRTUAL = 64


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Places in clockwise order: positions (signed 64 bits) and shards."""
    at = np.array([xxhash.xxh64_intdigest(f"{s}/{v}") for s in range(shards) for v in range(virtual)], np.uint64).view(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], order // virtual


def accepted_runs(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, last rank + 1, shard, slot of the first) under bounded loads."""
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    arcs, runs, waiting, step = len(owners), [], [(a, 0) for a in range(len(owners)) if counts[a]], 0
    while waiting:
        still = []
        for arc, rank in waiting:
            shard = int(owners[(arc + step) % arcs])
            take = min(room[shard] - used[shard], int(counts[arc]) - rank)
            if take:
                runs.append((arc, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank += take
            if rank < counts[arc]:
                still.append((arc, rank))
        waiting, step = still, step + 1
    return runs


def shard(docs: DataFrame, shards: int = 16, virtual: int = VIRTUAL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot. Texts are read once and never shuffled."""
    spark = docs.sparkSession
    rows = source(docs, doc_id=doc_id, text=text).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("doc_id").alias("_at"))
    places, owners = ring(shards, virtual)

    @F.pandas_udf("int")
    def arc(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, at.to_numpy(np.int64)) % len(places)).astype("int32")

    rows = cut(rows.withColumn("_arc", arc("_at")))
    found = rows.groupBy("_arc").count().collect()  # at most shards x virtual rows
    counts = np.zeros(len(places), np.int64)
    for r in found:
        counts[r[0]] = r[1]
    table = spark.createDataFrame(accepted_runs(counts, owners, shards), "_arc int, _lo long, _hi long, shard int, _slot long")
    order = [F.col(c) for c in ("_at", "doc_id", "size", "text_crc32")]
    numbered = ranked(rows, "_arc", order, F.xxhash64("_at", "size", "text_crc32"), salts(int(counts.sum()) // 16), name="_rank")
    placed = numbered.join(F.broadcast(table), (numbered["_arc"] == table["_arc"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))
