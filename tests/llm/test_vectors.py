"""Hard negatives and clusters against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import clustering, mining, queries

CLASH = ("row", "id", "anchor", "score", "dim", "wide", "vec", "cluster", "distance", "was")
SCHEMA = "vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], SCHEMA).repartition(parts)


def vectors(seed: int, n: int, dim: int, spread: float = 0.6) -> list[list[float]]:
    """Clusters whose energy falls from component to component, turned at random."""
    r = np.random.default_rng(seed)
    turn = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    centres = r.normal(size=(5, dim))
    rows = (centres[r.integers(0, 5, n)] + spread * r.normal(size=(n, dim))) * 0.8 ** np.arange(dim)
    return (rows @ turn).tolist()


def whole(v, scale):
    """The vector as integers; none if it takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def mined(rows, positives=5, negatives=10, low=30, high=90) -> Counter:
    kept = [(k, i, label, w) for k, (i, v, label) in enumerate(rows) if label is not None and (w := whole(v, 256)) is not None]
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for k, i, label, v in kept:
        if i is None or i % 100:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), j, other, m) for m, j, other, w in kept if m != k and len(w) == len(v)]
        same = sorted((s for s in score if s[2] == label), key=lambda s: (-s[0], last(s[1])))[:positives]
        for s, j, _, _ in same:
            fits = sorted((x for x in score if x[2] != label and low * s <= 100 * x[0] <= high * s), key=lambda x: (-x[0], last(x[1])))[:negatives]
            out.update((i, j, rank, x[1], s, x[0]) for rank, x in enumerate(fits, 1))
    return out


def found(df) -> Counter:
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def of_table(df):
    return mining.hard_negatives(df, F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize(("seed", "dim", "block"), [(1, 24, None), (2, 64, 4096), (3, 1, None)])
def test_hard_negatives_brute_force(spark, monkeypatch, seed, dim, block):
    if block:
        monkeypatch.setattr(mining, "BLOCK_BYTES", block)
    r = random.Random(seed)
    rows = [(i, v, r.randint(0, 3)) for i, v in enumerate(vectors(seed, 700, dim))]
    want = mined(rows)
    assert want and found(of_table(frame(spark, rows))) == want


def test_hard_negatives_odd_rows(spark):
    base = vectors(4, 60, 8)
    rows = [(100 * i if i % 3 == 0 else i, v, i % 4) for i, v in enumerate(base)]
    rows += [rows[0], rows[0], (0, base[5], 1), (None, base[6], 2), (None, base[6], 2), (None, base[7], 0), (300, base[9], 3), (300, base[9], 3)]  # repeated rows and ids, none
    rows += [(7, base[0], 1)] * 20 + [(100 * k, base[0], 0) for k in range(20)]  # ties
    rows += [(500, None, 1), (600, base[1], None), (700, [*base[1][:7], None], 1), (800, [*base[1][:7], math.nan], 2), (900, [*base[1][:7], math.inf], 2)]
    rows += [(1000, [], 1), (1100, [], 2), (1200, [], 1), (1300, base[1][:5], 1), (1400, base[2][:5], 1), (1500, base[1][:5], 2), (1600, [0.0] * 8, 3), (1700, [0.0] * 8, 1)]
    assert found(of_table(frame(spark, rows))) == mined(rows)
    assert found(of_table(frame(spark, rows, 40))) == mined(rows)
    assert of_table(frame(spark, [])).collect() == []
    assert of_table(frame(spark, [(None, [1.0], 1), (5, [1.0], 2)])).collect() == []


def test_hard_negatives_of_large_numbers(spark):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) * 10.0**p for _ in range(6)], i % 2) for i in range(210) for p in [r.choice([0, 3, 6])]]
    rows += [(1001, [1e30, 0, 0, 0, 0, 0], 1), (1003, [-1e30, 0, 0, 0, 0, 0], 0)]
    got = found(of_table(frame(spark, [x for x in rows if x[0] != 1003 and x[0] != 1001])))
    assert got == mined(rows[:-2])
    huge = [(0, [2.0**20, 1.0], 0), (1, [2.0**20, 0.0], 0), (2, [2.0**19, 3.0], 1), (3, [2.0**30, 1.0], 1)]  # scores beyond what a double holds exactly
    assert found(of_table(frame(spark, huge))) == mined(huge)
    with pytest.raises(Exception, match="64 bits"):
        of_table(frame(spark, [(0, [1e30, 0.0], 1), (1, [1e30, 0.0], 1), (2, [1.0, 0.0], 0)])).collect()


def test_bounds_discard_and_lose_nothing():
    v = np.floor(256 * np.array(vectors(5, 3000, 32)))
    n, labels, ids = 40, np.arange(3000) % 3, np.arange(3000)
    turned = mining.rotation(v)
    assert len(turned.steps) == 2 and np.allclose(turned.matrix @ turned.matrix.T, np.eye(32))
    low, high = np.full((n, 1), -(10**6)), np.full((n, 1), 10**9)
    lists, plain = (mining.Lists(v[:n], ids[:n], labels[:n], low, high, 10, False, t) for t in (turned, mining.Rotation(None, ())))
    pairs = 0
    for a in range(0, 3000, 500):
        part = slice(a, a + 500)
        if a:
            pairs += len(lists.survivors(slice(0, n), v[part], ids[part], labels[part])[0])
        for one in (lists, plain):
            one.add(v[part], ids[part], labels[part], ids[part])
    assert (lists.scores == plain.scores).all() and (lists.ids == plain.ids).all()
    assert 0 < pairs < 0.2 * n * 2500


def test_hard_negatives_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.op11_hard_negatives(spark, sf)) == mined(rows)


# ------------------------------------------------------------------ clusters


def lloyd(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, w) for i, v in rows if (w := whole(v, scale)) is not None and len(w) == dim]
    hashed = sorted(kept, key=lambda x: (x[0] is None, sha256(f"1:{x[0]}".encode()).hexdigest() if x[0] is not None else "", [b for c in x[1] for b in c.to_bytes(8, "little", signed=True)]))
    centroids = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return Counter((i, d[1], d[0]) for i, v in kept for d in [nearest(v)]), centroids


def clustered(df, **more) -> tuple[Counter, list]:
    rows, centroids = clustering.cluster(df, **more)
    return Counter((r["vec_id"], r["cluster"], r["distance"]) for r in rows.collect()), centroids


@pytest.mark.parametrize(("n", "k", "rounds", "dim"), [(400, 16, 3, 64), (300, 7, 9, 5), (9, 16, 3, 8), (50, 4, 0, 3)])
def test_clusters_brute_force(spark, n, k, rounds, dim):
    rows = list(enumerate(vectors(n, n, dim)))
    got = clustered(frame(spark, [(i, v, 1) for i, v in rows]), k=k, rounds=rounds, dim=dim)
    assert got == lloyd(rows, k, rounds, dim)


def test_clusters_of_odd_rows(spark):
    base = vectors(6, 40, 4)
    rows = [*enumerate(base), (3, base[3]), (3, base[3]), (3, base[4]), (None, base[5]), (None, base[6]), (8, None), (9, [1.0, None, 2.0, 3.0]), (10, [math.nan] * 4), (11, [1.0] * 3), (12, []), *[(50, base[0])] * 60]
    assert clustered(frame(spark, [(i, v, None) for i, v in rows]), k=16, dim=4) == lloyd(rows, 16, 3, 4)
    assert clustered(frame(spark, []), dim=4) == (Counter(), [])
    assert clustering.report(*clustering.cluster(frame(spark, []))).collect() == []
    large = [(i, [x * 1e6 for x in v]) for i, v in enumerate(base)]  # squares beyond what a double holds exactly
    assert clustered(frame(spark, [(i, v, 1) for i, v in large]), k=3, dim=4) == lloyd(large, 3, 3, 4)
    with pytest.raises(Exception, match="OverflowError|too large|not representable|out of"):
        clustered(frame(spark, [(i, [x * 1e12 for x in v], 1) for i, v in enumerate(base)]), k=3, dim=4)


def test_rounds_compare_only_what_changed():
    """An unchanged owner is compared with changed centroids alone: the others' coordinates are never looked at."""
    v = np.array([[0.0, 0.0], [10.0, 0.0], [20.0, 0.0]])
    owner, distance = np.array([0, 1, 2], np.int32), np.array([0, 0, 0])
    far = [[0, 0], [9, 0], [10**12, 0]]  # the third has not changed: its owner keeps the distance it had
    got = clustering.assign(v, owner, distance, far, [1])
    assert got[0].tolist() == [0, 1, 2] and got[1].tolist() == [0, 1, 0]
    assert clustering.assign(v, owner, distance, far, [2])[0].tolist() == [0, 1, 1]


def test_clusters_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, centroids = lloyd(rows)
    got = queries.op12_centroid_clustering(spark, sf).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    sums = Counter()
    for r in got:
        sums[r["cluster"]] += r["distance"]
    digest = lambda c: sha256(",".join(map(str, c)).encode()).hexdigest()
    assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) and r["centroid_sha256"] == digest(centroids[r["cluster"]]) for r in got)
