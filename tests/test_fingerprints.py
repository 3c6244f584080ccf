"""Content fingerprints: trees of digests, their changed ranges by descent, trees brought up to date."""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import functions as F

from riskweave.operators import index

SCHEMA = "_file string, _row long, content string"


def tree(rows) -> dict:
    files: dict = {}
    for f, k, t in rows:
        files.setdefault(f, {})[k] = sha1((t or "").encode()).hexdigest()
    out = {}
    for f, nodes in files.items():
        counts = dict.fromkeys(nodes, 1)
        for level in range(index.LEVELS + 1):
            up = (lambda r: 0) if level == index.LEVELS else (lambda r: r // index.DIGESTED)
            groups: dict = {}
            for r in sorted(nodes):
                groups.setdefault(up(r), []).append(r)
            counts = {g: sum(counts[r] for r in rs) for g, rs in groups.items()}
            nodes = {g: sha1("\x1f".join(nodes[r] for r in rs).encode()).hexdigest() for g, rs in groups.items()}
            out |= {(level, f, g): (counts[g], nodes[g]) for g in nodes}
    return out


def found(df) -> dict:
    return {(r["level"], r["_file"], r["_range"]): (r["n"], r["digest"]) for r in df.collect()}


def test_trees_of_digests(spark):
    rows = [(f, k, None if k % 7 == 0 else f"text {k} of {f}") for f, n in (("a", 9000), ("b", 1), ("c", index.DIGESTED)) for k in range(n)]
    df = spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)
    want = tree(rows)
    assert found(index.digest_tree(df)) == want
    assert {r["_file"]: (r["doc_count"], r["fingerprint"]) for r in index.fingerprints(df).collect()} == {f: want[index.LEVELS, f, 0] for f in "abc"}
    assert index.fingerprints(df.limit(0)).collect() == [] == index.digest_tree(df.limit(0)).collect()


def test_one_changed_row_is_found_and_costs_one_path(spark, tmp_path):
    df = spark.createDataFrame([("a", k, f"text {k}") for k in range(9000)] + [("b", 0, "b")], SCHEMA)
    later = df.withColumn("content", F.when((F.col("_file") == "a") & (F.col("_row") == 5000), "new").otherwise(F.col("content")))
    old, new = index.digest_tree(df).cache(), index.digest_tree(later).cache()
    changed = index.changed_ranges(old, new)
    assert [tuple(r) for r in changed.collect()] == [("a", 5000 // index.DIGESTED, "changed")]
    assert index.changed_ranges(old, old).collect() == []
    assert found(index.update_tree(old, later, changed, str(tmp_path / 'one'))) == found(new)
    assert found(new).items() - found(old).items() == {x for x in found(new).items() if x[0][1] == "a" and x[0][2] == (0 if x[0][0] == index.LEVELS else 5000 // index.DIGESTED ** (x[0][0] + 1))}
    appended = later.unionByName(spark.createDataFrame([("a", 9000, "end"), ("c", 0, "c")], SCHEMA))
    ranges = spark.createDataFrame([("a", 9000 // index.DIGESTED), ("c", 0)], "_file string, _range long")
    assert found(index.update_tree(new, appended, ranges, str(tmp_path / 'two'))) == found(index.digest_tree(appended))
    gone = later.where("_file <> 'b' AND _row < 8990")
    assert {tuple(r) for r in index.changed_ranges(new, index.digest_tree(gone)).collect()} == {("a", 8999 // index.DIGESTED, "changed" if 8990 % index.DIGESTED else "removed"), ("b", 0, "removed")}
