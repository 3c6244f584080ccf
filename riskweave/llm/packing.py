"""Best-fit packing of pieces into sequences, in bulk-synchronous sweeps.

As many empty sequences as the units need at least are opened. Pieces come in classes of
length, long ones first. Every round

1. range-sorts the pieces of the class and the gaps of all sequences together by size;
2. matches them in a sweep upwards in every range: a gap takes its nearest predecessor, the
   longest piece that fits and that no smaller gap took, and what is left of the gap goes
   on until nothing in the range fits;
3. resolves what remains across ranges by rank: pieces and gaps are numbered within their
   size, a sweep over the counts of the sizes, at most two for each unit of capacity, says
   which ranks of which sizes meet, and they meet in a join;
4. updates the gaps, and repeats while pieces of the class are left; if none fits, as many
   sequences are opened as these need at least.

A range has about RANGE rows, so a size that a third of all pieces has is several ranges.
The number of rounds hangs on the capacity, not on the rows. Rows equal in every column are
pieces of their own; an empty table gives an empty one; other columns are carried along,
clashing names included.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_encoder
from .common import batch_of, cut, slices, source

#: Rows of a range; each class of lengths ends where the next one begins, at a share of it.
RANGE, CLASS = 250_000, 4
#: Kinds of rows in a sweep.
PIECE, GAP, PLACED = 0, 1, 2


def successors(pieces: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted sizes of pieces and of gaps that match: from the smallest gap up, each takes the longest piece still free that fits."""
    free: list[tuple[int, int]] = []
    ours, theirs, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    sizes, at = np.unique(gaps, return_index=True)
    for size, a, b in zip(sizes.tolist(), at.tolist(), [*at[1:].tolist(), len(gaps)]):
        if (end := int(np.searchsorted(pieces, size, "right"))) > seen:
            free.append((seen, end))
            seen = end
        while a < b and free:
            low, high = free.pop()
            n = min(b - a, high - low)
            ours.append(np.arange(high - 1, high - 1 - n, -1))
            theirs.append(np.arange(a, a + n))
            a += n
            if high - n > low:
                free.append((low, high - n))
    return np.concatenate(ours), np.concatenate(theirs)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The number of each row among those with its keys."""
    order = np.lexsort(keys)
    first = np.ones(len(order), bool)
    for k in keys:
        first[1:] &= k[order][1:] == k[order][:-1]
    first[0:1] = False
    new = np.flatnonzero(~first)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return out


def _range_swept(batches, capacity: int, schema: pa.Schema):
    """One range of pieces and gaps: placed pieces, pieces left, gaps left."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    kind, size, sequence = (rows[c].to_numpy().copy() for c in ("_kind", "_size", "_sequence"))
    offset = np.zeros(len(kind), np.int32)
    pieces, gaps = (np.flatnonzero(kind == k) for k in (PIECE, GAP))
    pieces = pieces[np.argsort(size[pieces], kind="stable")]
    while len(pieces) and len(gaps):
        gaps = gaps[np.argsort(size[gaps], kind="stable")]
        ours, theirs = successors(size[pieces], size[gaps])
        if not len(ours):
            break
        mine, gap = pieces[ours], gaps[theirs]
        kind[mine], sequence[mine], offset[mine] = PLACED, sequence[gap], capacity - size[gap]
        size[gap] -= size[mine]
        pieces, gaps = np.delete(pieces, ours), gaps[size[gaps] > 0]
    found = {"_kind": kind, "_size": size, "_sequence": sequence, "_offset": offset, "_part": np.full(len(kind), TaskContext.get().partitionId(), np.int32), "_rank": _ranks(kind, size)}
    out = pa.Table.from_arrays([pa.array(found[f.name], f.type) if f.name in found else rows[f.name].combine_chunks() for f in schema], schema=schema)
    yield from out.filter(pa.array((kind != GAP) | (size > 0))).to_batches(max_chunksize=50_000)


def meetings(pieces: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """A sweep over counts of sizes: (piece size, its first rank, gap size, its first rank, how many); under two for each size."""
    free: list[list[int]] = []
    out = []
    for size in sorted({*pieces, *gaps}):
        if size in pieces:
            free.append([size, 0, pieces[size]])
        rank, n = 0, gaps.get(size, 0)
        while rank < n and free:
            top = free[-1]
            take = min(n - rank, top[2] - top[1])
            out.append((top[0], top[1], size, rank, take))
            rank += take
            top[1] += take
            if top[1] == top[2]:
                free.pop()
    return out


def _across(state: DataFrame, capacity: int) -> DataFrame:
    """Match what no range could: ranks of equal sizes meet. Gives the whole state again."""
    spark, open_ = state.sparkSession, state.where(F.col("_kind") < PLACED)
    counts = cut(open_.groupBy("_kind", "_size", "_part").agg(F.count("*").alias("_n")))
    found: dict[int, dict[int, int]] = {PIECE: {}, GAP: {}}
    for r in counts.groupBy("_kind", "_size").agg(F.sum("_n").alias("n")).collect():  # at most two for each unit of capacity
        found[r["_kind"]][r["_size"]] = r["n"]
    met = meetings(found[PIECE], found[GAP])
    if not met:
        return state
    sides = [row for k, (size, rank, gap, at, n) in enumerate(met) for row in ((PIECE, size, rank, rank + n, k), (GAP, gap, at, at + n, k))]  # under four for each unit
    table = F.broadcast(spark.createDataFrame(sides, "_kind int, _size int, _lo long, _hi long, _meeting int"))
    ahead = Window.partitionBy("_kind", "_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = open_.join(counts.select("_kind", "_size", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")), ["_kind", "_size", "_part"]).withColumn("_at", F.col("_ahead") + F.col("_rank"))
    same = (ranked["_kind"] == table["_kind"]) & (ranked["_size"] == table["_size"]) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    numbered = cut(ranked.join(table, same, "left").select(*(ranked[c] for c in state.columns), "_meeting", (F.col("_at") - F.col("_lo")).alias("_place")))
    on, alone = ["_meeting", "_place"], numbered.where("_meeting IS NULL").select(*state.columns)
    ours, theirs = (numbered.where((F.col("_kind") == k) & F.col("_meeting").isNotNull()) for k in (PIECE, GAP))
    gap = theirs.select(*on, F.col("_size").alias("_gap"), F.col("_sequence").alias("_theirs"))
    placed = ours.join(gap, on).withColumns({"_kind": F.lit(PLACED), "_sequence": F.col("_theirs"), "_offset": (F.lit(capacity) - F.col("_gap")).cast("int")})
    less = theirs.join(ours.select(*on, F.col("_size").alias("_less")), on).withColumn("_size", F.col("_size") - F.col("_less")).where("_size > 0")
    return state.where(F.col("_kind") == PLACED).unionByName(alone).unionByName(placed.select(*state.columns)).unionByName(less.select(*state.columns))


def swept(rows: DataFrame, ranges: int, capacity: int) -> DataFrame:
    """One round over pieces of a class and gaps."""
    schema = pa.schema([pa.field(f.name, t) for f, t in zip(rows.schema, _arrow_types(rows))])
    rows = rows.repartition(1) if ranges == 1 else rows.repartitionByRange(ranges, "_size", "_kind", F.rand(7))
    state = cut(rows.mapInArrow(lambda it: _range_swept(it, capacity, schema), rows.schema))
    return state if ranges == 1 else cut(_across(state, capacity))


def _arrow_types(df: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema).types)


def pack(pieces: DataFrame, length: str = "length", capacity: int = 1024, rows_of_range: int = RANGE) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to `capacity` units; a length that is null or out of range fails the job."""
    spark, columns = pieces.sparkSession, pieces.columns
    inner = [f"_{k}" for k in range(len(columns))]  # own names: a column may be called as one of ours
    items = cut(pieces.toDF(*inner).withColumn("_length", F.col(inner[columns.index(length)]).cast("int")))
    bounds = [capacity + 1]
    while bounds[-1] > 1:
        bounds.append(max(1, (bounds[-1] - 1) // (2 if len(bounds) == 1 else CLASS)))
    number = F.lit(0)
    for b in bounds[1:-1]:
        number = number + (F.col("_length") < b).cast("int")
    totals = {r["k"]: r for r in items.groupBy(F.when(F.col("_length").between(1, capacity), number).otherwise(-1).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("_length").cast("long")).alias("units")).collect()}
    if -1 in totals:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    nothing = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in inner]
    state_of = lambda df, kind, size, sequence, first: df.select(*first, F.lit(kind).alias("_kind"), size.cast("int").alias("_size"), sequence.cast("long").alias("_sequence"), F.lit(0).alias("_offset"), F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_rank"))
    opened, done, gaps, n_gaps = 0, [], None, 0

    def more(units: int) -> None:
        nonlocal opened, gaps, n_gaps
        n = -(-units // capacity)
        fresh = state_of(spark.range(opened, opened + n), GAP, F.lit(capacity), F.col("id"), nothing)
        gaps, opened, n_gaps = fresh if gaps is None else gaps.unionByName(fresh), opened + n, n_gaps + n

    more(sum(r["units"] for r in totals.values()))
    for k, (high, low) in enumerate(zip(bounds, bounds[1:])):
        left = state_of(items.where((F.col("_length") >= low) & (F.col("_length") < high)), PIECE, F.col("_length"), F.lit(-1), [F.col(c) for c in inner])
        n = totals[k]["n"] if k in totals else 0
        while n:
            ranges = max(1, -(-(n + n_gaps) // rows_of_range))
            state = swept(left.unionByName(gaps), ranges, capacity)
            stats = {r["_kind"]: r for r in state.groupBy("_kind").agg(F.count("*").alias("n"), F.sum(F.col("_size").cast("long")).alias("units")).collect()}
            before, n, n_gaps = n, stats[PIECE]["n"] if PIECE in stats else 0, stats[GAP]["n"] if GAP in stats else 0
            done.append(state.where(F.col("_kind") == PLACED).select(*inner, "_sequence", "_offset"))
            left, gaps = state.where(F.col("_kind") == PIECE), state.where(F.col("_kind") == GAP)
            if n and (n == before or ranges == 1):
                more(stats[PIECE]["units"])
    out = done[0] if done else items.select(*inner, F.lit(0).cast("long").alias("_sequence"), F.lit(0).alias("_offset"))
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, columns)), F.col("_sequence").alias("sequence_id"), F.col("_offset").cast("long").alias("offset"))


def _pieces(batches, path: str, end_id: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    encode, end = byte_encoder(path), np.array([end_id], "<u4")
    for part in slices(batches, "text"):
        out: list[tuple] = []
        for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
            ids = np.concatenate((encode(text or ""), end)).astype("<u4").tobytes()
            n = len(ids) // 4
            cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        yield batch_of(schema, dict(zip(schema.names, zip(*out))))


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokenize whole texts (null: empty), add the end id, cut only what is longer than `capacity`; the first piece may be shorter. Rows are documents of their own, whatever their doc_id, which may be null."""
    docs = source(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(lambda it: _pieces(it, path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, path, end_id, capacity, text, doc_id), "length", capacity)
