"""Hard negatives by an exact search with an orthogonal PCA rotation.

Scores are integer inner products of vectors of whole numbers. A rotation, from the
eigenvectors of the second moments of a bounded sample, puts most of every product into its
leading components and changes no product. For a pair the products of the leading components
are accumulated; what remains is at most the product of the residual norms, and the rounding
of the accumulated part has a bound, too. A pair whose score can no longer reach the last
place of its list, or that must lie over its window, goes early; every survivor is verified by
the integer product itself, so lists are exact. The rotation decides speed only.

Anchors come in blocks of bounded bytes, broadcast; every block is two passes over all
rows, each task streaming its rows against the block and handing on only its best lists: one
for the positives, one for the negatives in the windows these set. No row is shuffled, no pair
is emitted that isn't in a task's own best list.

Defined results: rows with a null label, a null vector or a component that is null or not
finite take no part; vectors of different lengths have no score with each other, empty vectors
score 0 with empty ones; a row without vec_id comes after all others among ties and keeps a
null id; rows with the same vec_id, repeated rows included, are rows of their own: each is an
anchor or a positive of its own, so equal results come as often; an anchor with no positive,
and a positive with no row in its window, give no row; an empty table gives an empty result; a
positive score beyond 64 bits is an error; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST, batch_of, cut, new_folder
from .vectors import largest, packed, unpacked

#: Bytes of anchors, as doubles, in a block; rows of a task at least, if there are more than the session's tasks.
BLOCK_BYTES, TASK_ROWS = 1 << 23, 1 << 17
#: Rows of the sample that the rotation comes from; longest vector that is rotated; the part of the sample from which a length has a rotation of its own.
SAMPLED, ROTATED, COMMON = 4096, 512, 16
#: Shares of the sample's energy that may be left when a pair is tested.
LEFT = (0.25, 0.0625)
#: Rows and anchors that a task multiplies at a time; share of pairs from which survivors are verified by one matrix product.
ROWS, ANCHORS, DENSE = 4096, 512, 0.02
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Rotation(NamedTuple):
    #: An orthogonal matrix, none for the vectors' own axes, and the numbers of leading components at which pairs are tested.
    matrix: np.ndarray | None
    steps: tuple[int, ...]


def rotation(sample: np.ndarray) -> Rotation:
    """Of the eigenvectors of the second moments, the ones with most energy first."""
    scale = largest(sample) or 1.0
    energy, vectors = np.linalg.eigh((sample / scale).T @ (sample / scale))
    share = np.cumsum(energy[::-1].clip(0)) / max(energy.clip(0).sum(), 1e-300)
    steps = {int(np.searchsorted(share, 1 - left)) + 1 for left in LEFT}
    return Rotation(np.ascontiguousarray(vectors[:, ::-1]), tuple(sorted(s for s in steps if s < sample.shape[1])))


def rotations(rows: DataFrame, count: int) -> dict[int, Rotation]:
    """A rotation for each common length, from a sample of about SAMPLED rows."""
    share = max(1, count // SAMPLED)
    some = rows.where((F.col("dim") > 1) & (F.col("dim") <= ROTATED) & (F.pmod(F.xxhash64("row"), F.lit(share)) == 0)).select("dim", "wide", "vec").limit(2 * SAMPLED).toPandas()
    out = {}
    for dim, part in some.groupby("dim"):
        if COMMON * len(part) >= len(some):
            out[int(dim)] = rotation(unpacked(list(part["vec"]), part["wide"].to_numpy(bool), int(dim)))
    return out


def products(one: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows i of one matrix with rows j of another, as 64-bit integers; those that don't fit are at the ends of the range."""
    bound = largest(one) * largest(other) * max(1, one.shape[1])
    if bound < 2**53:
        if len(i) > DENSE * len(one) * len(other):
            kind = np.float32 if bound < 2**24 else np.float64
            return (one.astype(kind) @ other.astype(kind).T)[i, j].astype(np.int64)
        return np.concatenate([np.einsum("rd,rd->r", one[i[a : a + 8192]], other[j[a : a + 8192]]) for a in range(0, len(i), 8192)] or [np.zeros(0)]).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (one, other)]
    return np.array([max(LEAST + 1, min(MOST, sum(x * y for x, y in zip(whole[0][a], whole[1][b])))) for a, b in zip(i.tolist(), j.tolist())], np.int64)


class Lists:
    """The best rows of each anchor in each of its windows, over the rows seen so far.

    `low` and `high` (anchor, window) bound the scores, ends included; `top` rows are kept,
    higher scores first, then smaller ids.
    """

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, top: int, same: bool, turned: Rotation):
        self.vectors, self.rows, self.labels, self.low, self.high, self.top, self.same, self.turned = vectors, rows, labels, low, high, top, same, turned
        self.scores = np.full((*low.shape, top), LEAST, np.int64)
        self.ids = np.full((*low.shape, top), MOST, np.int64)

    def add(self, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        for a in range(0, len(self.vectors), ANCHORS):
            part = slice(a, a + ANCHORS)
            i, j = self.survivors(part, vectors, rows, labels)
            if len(i):
                score = products(self.vectors[part], vectors, i, j)
                for k in range(self.low.shape[1]):
                    self.insert(k, i + a, score, ids[j])

    def survivors(self, part: slice, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an anchor of the part and a row whose score may be in a list."""
        mine = self.vectors[part]
        alive = (self.labels[part][:, None] == labels[None, :]) == self.same
        if self.same:
            alive &= self.rows[part][:, None] != rows[None, :]
        floor = np.maximum(self.low[part], self.scores[part, :, -1]).min(axis=1)[:, None]
        roof = self.high[part].max(axis=1)[:, None]
        floor, roof = np.where(floor <= LEAST + 1, -np.inf, floor), np.where(roof == MOST, np.inf, roof)
        if not self.turned.steps:
            return np.nonzero(alive)
        kind = np.float32 if max(largest(mine), largest(vectors)) <= 2**20 else np.float64
        with np.errstate(over="ignore", invalid="ignore"):
            x, y = (m if self.turned.matrix is None else m @ self.turned.matrix for m in (mine, vectors))
            x_tail, y_tail = (np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9) for m in (x, y))
            # Of the rotation, the conversion and the sum: a few units of the last place of the norms' product for each component.
            slack = 4 * (x.shape[1] + 8) * np.finfo(kind).eps * x_tail[:, :1] * y_tail[:, 0][None, :]
            x, y, done = x.astype(kind), y.astype(kind), 0
            sums = np.zeros((len(x), len(y)), kind)
            for step in self.turned.steps:
                sums += x[:, done:step] @ y[:, done:step].T
                room = x_tail[:, step : step + 1] * y_tail[:, step][None, :] + slack
                alive &= ~(sums + room < floor)
                alive &= ~(sums - room > roof)
                done = step
                if not alive.any():
                    break
        return np.nonzero(alive)

    def insert(self, k: int, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score >= np.maximum(self.low[:, k], self.scores[:, k, -1])[i]) & (score <= self.high[:, k][i])
        if not fits.any():
            return
        i, score, ids = i[fits], score[fits], ids[fits]
        touched = np.unique(i)
        old = self.scores[touched, k] > LEAST
        i = np.concatenate((i, np.repeat(touched, self.top)[old.ravel()]))
        score, ids = np.concatenate((score, self.scores[touched, k][old])), np.concatenate((ids, self.ids[touched, k][old]))
        order = np.lexsort((ids, -score, i))
        i, score, ids = i[order], score[order], ids[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        best = place < self.top
        self.scores[touched, k], self.ids[touched, k] = LEAST, MOST
        self.scores[i[best], k, place[best]], self.ids[i[best], k, place[best]] = score[best], ids[best]


class Block(NamedTuple):
    """Anchors of one length; `positives` (anchor, window): id and score of the positive that sets the window."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positives: tuple[np.ndarray, np.ndarray]


_FOUND = "anchor long, window int, anchor_id long, positive_id long, positive_score long, id long, score long"


def _searched(batches, blocks: dict[int, Block], turned: dict[int, Rotation], top: int, same: bool):
    """The best lists of this task's rows."""
    schema = pa.schema([(n, pa.int32() if n == "window" else pa.int64()) for n in ("anchor", "window", "anchor_id", "positive_id", "positive_score", "id", "score")])
    lists = {d: Lists(b.vectors, b.rows, b.labels, b.low, b.high, top, same, turned.get(d, Rotation(None, ()))) for d, b in blocks.items()}
    rows_at_once = ROWS // 8  # the first rows set the lists' last places for all others
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            if dim not in lists:
                continue
            places = np.flatnonzero(dims == dim)
            a = 0
            while a < len(places):
                b = batch.take(pa.array(places[a : a + min(rows_at_once, max(1, (1 << 22) // max(1, dim)))], pa.int64()))
                a += b.num_rows
                rows_at_once = min(ROWS, 2 * rows_at_once)
                vectors = unpacked(b["vec"].to_pylist(), b["wide"].to_numpy(zero_copy_only=False), dim)
                lists[dim].add(vectors, b["row"].to_numpy(), b["label"].to_numpy(), b["id"].to_numpy())
    for dim, found in lists.items():
        block = blocks[dim]
        i, k, r = np.nonzero(found.scores > LEAST)
        yield batch_of(schema, {
            "anchor": block.rows[i], "window": k.astype(np.int32), "anchor_id": block.ids[i], "positive_id": block.positives[0][i, k], "positive_score": block.positives[1][i, k],
            "id": found.ids[i, k, r], "score": found.scores[i, k, r],
        })


def _search(scan: DataFrame, blocks: dict[int, Block], turned: dict[int, Rotation], top: int, same: bool) -> DataFrame:
    """The `top` best rows of all for each anchor and window, with their rank."""
    shared = scan.sparkSession.sparkContext.broadcast((blocks, turned))  # BLOCK_BYTES of anchors, at most COMMON rotations
    found = scan.mapInArrow(lambda it: _searched(it, *shared.value, top, same), _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def _empty(n: int, windows: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, windows), low, np.int64), np.full((n, windows), high, np.int64)


def _blocks(anchors: DataFrame) -> dict[int, Block]:
    """One block of anchors, by length, with one window that takes every score."""
    out = {}
    for dim, part in anchors.toPandas().groupby("dim"):  # BLOCK_BYTES of vectors
        n, zero = len(part), np.zeros((len(part), 1), np.int64)
        vectors = unpacked(list(part["vec"]), part["wide"].to_numpy(bool), int(dim))
        out[int(dim)] = Block(*(part[c].to_numpy(np.int64) for c in ("row", "id", "label")), vectors, *_empty(n, 1, LEAST + 1, MOST), (zero, zero))
    return out


def _windows(block: Block, found, positives: int, low: int, high: int) -> Block:
    """The block with a window for each positive: low * positive <= 100 * score <= high * positive."""
    n = len(block.rows)
    lows, highs = _empty(n, positives, MOST, LEAST)
    ids, scores = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
    place = {row: i for i, row in enumerate(block.rows.tolist())}
    for row, rank, id_, score in zip(*(found[c].tolist() for c in ("anchor", "rank", "id", "score"))):
        if (i := place.get(row)) is not None:
            if score == MOST or score == LEAST + 1:
                raise ArithmeticError("the score of a positive does not fit in 64 bits")
            k = rank - 1
            ids[i, k], scores[i, k], lows[i, k], highs[i, k] = id_, score, -(-low * score // 100), high * score // 100
    return block._replace(low=lows, high=highs, positives=(ids, scores))


def hard_negatives(
    rows: DataFrame, anchor: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str | Column = "label", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` says which rows are anchors. An anchor's positives are the best `positives`
    other rows of its label; for each, the best `negatives` rows of other labels between `low`
    and `high` percent of the positive's score are returned, rank from 1.
    """
    spark: SparkSession = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    plain = rows.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(LAST)).alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"))
    table = cut(packed(plain.where("label IS NOT NULL AND vector IS NOT NULL"), "vector", scale).withColumn("row", F.monotonically_increasing_id()))
    count, n_anchors, size = table.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.sum(F.when(F.col("anchor"), 8 * F.col("dim") + 64)), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
    scan = table.select("row", "id", "label", "dim", "wide", "vec").coalesce(tasks)
    turned = rotations(table, count) if n_anchors else {}
    blocks, parts = -(-size // BLOCK_BYTES), []
    for b in range(blocks):
        mine = table.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "id", "label", "dim", "wide", "vec")
        block = _blocks(mine)
        best = _search(scan, block, turned, positives, True).select("anchor", "rank", "id", "score").toPandas()  # `positives` rows for each anchor of the block
        block = {d: _windows(x, best, positives, low, high) for d, x in block.items()}
        parts.append(new_folder(spark, "negatives"))
        _search(scan, block, turned, negatives, False).write.parquet(parts[-1])
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = lambda c, name: F.when(F.col(c) != LAST, F.col(c)).alias(name)
    return spark.read.parquet(*parts).select(named("anchor_id", "anchor_id"), named("positive_id", "positive_id"), F.col("rank").cast("int").alias("rank"), named("id", "negative_id"), "positive_score", F.col("score").alias("negative_score"))
