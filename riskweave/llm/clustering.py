"""Centroid clustering by delta Lloyd rounds on whole numbers.

Vectors are packed as integers once, and each one's owner and distance are kept with it
from round to round. A round compares a vector only with the centroids that changed in the
round before; a vector whose own centroid moved is compared with all. What leaves its owner
is a signed transfer: the vector and a count of one are taken from the old cluster and added
to the new one. Tasks add their transfers up first, so a round sends at most a row of sums for
each task and cluster, however many vectors a cluster has; the global sums, one row of integers
a cluster, stay with the driver and take only these transfers. Everything is exact.

Every round's table is written to the shared folder and the one before it removed, so a
lost executor repeats tasks of one round only. The centroids, `k` rows, are what is broadcast.

Defined results: vectors of another length than `dim`, null ones and those with a component
that is null or not finite are left out; of nearest centroids the one with the smaller number
owns the vector; with fewer vectors than `k` there are as many centroids as vectors; starting
vectors with equal hashes come in the order of their components; rows without vec_id start a
cluster only if there are not enough others; rows that repeat are vectors of their own, and a
centroid equal to an earlier one stays empty and where it is; an empty table gives an empty
result; a sum beyond 38 digits or a distance beyond 64 bits is an error; other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, written
from .vectors import largest, packed, unpacked

#: Vectors that a task compares at a time.
ROWS = 4096
_STATE = "vec_id long, wide boolean, vec binary, cluster int, distance long, was int"


def distances(vectors: np.ndarray, centroids: list[list[int]], which: list[int]) -> np.ndarray:
    """Exact squared distances (vector, of `which` centroids): floats while these hold them exactly, Python's integers beyond."""
    some = np.array([centroids[j] for j in which], np.float64).reshape(len(which), vectors.shape[1])
    if vectors.shape[1] * (largest(vectors) + largest(some)) ** 2 < 2**52:
        return ((vectors * vectors).sum(axis=1)[:, None] - 2 * vectors @ some.T + (some * some).sum(axis=1)[None, :]).astype(np.int64)
    whole = [[int(x) for x in v] for v in vectors.tolist()]
    return np.array([[sum((x - y) ** 2 for x, y in zip(v, centroids[j])) for j in which] for v in whole], object).reshape(len(vectors), len(which))


def assign(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: list[list[int]], changed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The new owner and distance of each vector; an owner of -1 counts as moved."""
    owner, distance = owner.copy(), distance.astype(object)
    moved = np.isin(owner, [-1, *changed])
    for rows, which in ((np.flatnonzero(moved), list(range(len(centroids)))), (np.flatnonzero(~moved), changed)):
        if len(rows) and which:
            d = distances(vectors[rows], centroids, which)
            at = d.argmin(axis=1)  # the first of the nearest
            best, number = d[np.arange(len(rows)), at], np.array(which)[at]
            takes = moved[rows] | (best < distance[rows]) | (best == distance[rows]) & (number < owner[rows])
            owner[rows[takes]], distance[rows[takes]] = number[takes], best[takes]
    return owner, distance


def _assigned(batches, dim: int, centroids: list[list[int]], changed: list[int]):
    schema = pa.schema([("vec_id", pa.int64()), ("wide", pa.bool_()), ("vec", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("was", pa.int32())])
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            vectors = unpacked(part["vec"].to_pylist(), part["wide"].to_numpy(zero_copy_only=False), dim)
            was = part["cluster"].to_numpy()
            owner, distance = assign(vectors, was, part["distance"].to_numpy(), centroids, changed)
            yield batch_of(schema, {"vec_id": part["vec_id"], "wide": part["wide"], "vec": part["vec"], "cluster": owner.astype(np.int32), "distance": [int(x) for x in distance], "was": was})


def _transfers(batches, dim: int):
    """The task's signed sums of counts and components by cluster; the count is the component before the first."""
    sums: dict[int, list[int]] = {}
    for batch in batches:
        vectors = unpacked(batch["vec"].to_pylist(), batch["wide"].to_numpy(zero_copy_only=False), dim)
        for column, sign in (("was", -1), ("cluster", 1)):
            of = batch[column].to_numpy()
            for c in np.unique(of[of >= 0]).tolist():
                mine = vectors[of == c]
                total = mine.sum(axis=0) if largest(mine) * len(mine) < 2**52 else [sum(int(x) for x in column_) for column_ in mine.T.tolist()]
                now = sums.setdefault(c, [0] * (dim + 1))
                for at, x in enumerate((len(mine), *total)):
                    now[at] += sign * int(x)
    schema = pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("sum", pa.decimal128(38, 0))])
    for c, values in sums.items():
        yield batch_of(schema, {"cluster": [c] * (dim + 1), "at": list(range(dim + 1)), "sum": pa.array(values, pa.decimal128(38, 0))})


def starts(vectors: DataFrame, k: int, dim: int, seed: str = "1:") -> list[list[int]]:
    """The `k` vectors whose ids have the smallest hashes, in that order."""
    first = vectors.withColumn("hash", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)).orderBy(F.col("hash").asc_nulls_last(), "wide", "vec").limit(k)
    return [[int(x) for x in unpacked([bytes(r["vec"])], np.array([r["wide"]]), dim)[0]] for r in first.select("wide", "vec").collect()]


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, vector: str = "embedding", vec_id: str = "vec_id", seed: str = "1:") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector after `rounds` rounds and a last assignment, and the final centroids."""
    spark = table.sparkSession
    plain = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    base, folder = written(packed(plain, "vector", scale, dim).select("vec_id", "wide", "vec"), "vectors")
    centroids = starts(base, k, dim, seed)
    changed, sums = list(range(len(centroids))), [[0] * (dim + 1) for _ in centroids]
    state = base.select("*", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    for round_ in range(rounds + 1):
        if not changed:
            break
        now, moved = list(centroids), list(changed)
        found = state.select("vec_id", "wide", "vec", "cluster", "distance").mapInArrow(lambda it, now=now, moved=moved: _assigned(it, dim, now, moved), _STATE)
        state, newer = written(found, "assignments")
        discard(spark, folder)
        folder = newer
        if round_ == rounds:
            break
        gone = state.where("cluster <> was").select("vec", "wide", "was", "cluster").mapInArrow(lambda it: _transfers(it, dim), "cluster int, at int, sum decimal(38,0)")
        for r in gone.groupBy("cluster", "at").agg(F.sum("sum").alias("sum")).collect():  # a number for each centroid and component
            sums[r["cluster"]][r["at"]] += int(r["sum"])
        means = [[x // s[0] for x in s[1:]] if s[0] else c for c, s in zip(centroids, sums)]
        changed = [j for j, (a, b) in enumerate(zip(centroids, means)) if a != b]
        centroids = means
    return state.select("vec_id", "cluster", "distance"), centroids


def report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256, the digest of the final centroid's components."""
    spark = assigned.sparkSession
    digests = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).crossJoin(F.broadcast(assigned.agg(F.sum("distance").alias("inertia"))))
    return assigned.join(F.broadcast(sums.join(digests, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid
