"""Training by epochs against one thread of numpy, segmentation against all splits, edits written back."""

from __future__ import annotations

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.segment import Dictionary, dictionary_tokenizer
from riskweave.functions.text import signature
from riskweave.operators import search, segments, training, verify
from riskweave.schema import COLUMNS
from riskweave.sources.messages import write_messages


def test_epochs_equal_one_thread(spark, tmp_path):
    r = random.Random(2)
    rows = [(" ".join(r.choices(["storm", "flood", "panic"] if k % 3 == 0 else ["report", "check", "calm"], k=4)) + f" n{k} shared", int(k % 3 == 0), "validation" if k % 5 == 0 else "train") for k in range(200)]
    data = spark.createDataFrame(rows, "content string, label int, part string")
    n, epochs, batches, rate = 512, 3, 4, 2.0
    got = training.train_epochs(data.repartition(7), epochs, batches, rate, n, str(tmp_path))
    again = training.train_epochs(data.coalesce(1), epochs, batches, rate, n)
    assert (got.weights == again.weights).all() and got.history.collect() == again.history.collect()
    flat = [(x["content"], x["label"], x["part"], x["places"], [x[f"b{e}"] for e in range(1, epochs + 1)]) for x in training.encoded(data, n).select("*", *(F.pmod(F.xxhash64(F.lit(e), "content"), F.lit(batches)).alias(f"b{e}") for e in range(1, epochs + 1))).collect()]
    w, best, want = np.zeros(n + 1), 0.0, []
    p = lambda places: 1 / (1 + math.exp(-sum(w[i] for i in places)))
    for e in range(epochs):
        loss = []
        for b in range(batches):
            step, mine = np.zeros(n + 1), [x for x in flat if x[2] == "train" and x[4][e] == b]
            for _, y, _, places, _ in mine:
                q = p(places)
                loss.append(-math.log(q if y else 1 - q))
                step[places] += q - y
            w = w - rate * step / max(1, len(mine))
        held = [(p(x[3]) >= 0.5) == (x[1] == 1) for x in flat if x[2] == "validation"]
        accuracy = sum(held) / len(held)
        best = max(best, accuracy)
        want.append((e + 1, sum(loss) / len(loss), accuracy, best, accuracy >= best))
    for one, other in zip(got.history.orderBy("epoch").collect(), want):
        assert one["epoch"] == other[0] and one["loss"] == pytest.approx(other[1], abs=1e-6) and (one["accuracy"], one["best"], one["saved"]) == other[2:]
    assert want[-1][1] < want[0][1] and best > 0.9 and spark.read.parquet(f"{tmp_path}/weights").count() > 5
    assert training.train_epochs(data.limit(0), 1, 2, 1.0, 8).history.first()["accuracy"] == 0


def share(d: Dictionary, words) -> float:
    return sum(d.shares[w] if w in d.shares else -d.total if len(w) == 1 else -math.inf for w in words)


def test_paths_equal_all_splits():
    r = random.Random(4)
    for _ in range(60):
        counts = {"".join(r.choices("天地人水", k=r.randint(1, 4))): r.randint(1, 50) for _ in range(12)}
        d, run = Dictionary(counts), "".join(r.choices("天地人水火", k=r.randint(1, 9)))
        splits = [[run[a:b] for a, b in zip((0, *cut), (*cut, len(run)))] for k in range(len(run)) for cut in itertools.combinations(range(1, len(run)), k)]
        found = d.path(run)
        assert "".join(found) == run and share(d, found) == pytest.approx(max(share(d, s) for s in splits))
    assert Dictionary({}).tokens("水火 Abc_1 é") == ["水", "火", "abc", "1", "é"] and Dictionary({"水火": 2}).tokens(None) == []
    assert Dictionary({"研究": 5, "研究生": 3, "生命": 6, "起源": 4}).tokens("研究生命起源") == ["研究", "生命", "起源"]
    with pytest.raises(ValueError, match="more than 1"):
        dictionary_tokenizer({"a": 1, "b": 1}, most=1)


def messages(spark, rows):
    df = spark.createDataFrame(rows, "_file string, _row long, content string, nature string")
    return df.withColumns({c: F.lit("") for c in COLUMNS if c not in df.columns}).withColumn("_signature", signature())


def test_index_and_search_with_a_dictionary(spark, tmp_path):
    words = dictionary_tokenizer(spark.createDataFrame([("研究", 5), ("研究生", 3), ("生命", 6), ("起源", 4), ("生命", 1)], "word string, count long"))
    index = segments.Index(spark, str(tmp_path), words)
    index.update(messages(spark, [("a", 0, "研究生命起源", ""), ("a", 1, "研究生 abc", ""), ("a", 2, "生命", "")]))
    assert {r["term"]: r["df"] for r in index.terms().collect()} == {"研究": 1, "生命": 2, "起源": 1, "研究生": 1, "abc": 1}
    assert {r["_row"] for r in search.search_index(index, "生命起源").collect()} == {0, 2}


def test_edits_are_written_back(spark, tmp_path):
    path = str(tmp_path / "m")
    m = messages(spark, [(f, k, f"text {k}", "未校验") for f in ("a b%", "c", "d") for k in range(3)])
    write_messages(m, path)
    stored = lambda: {(r["_file"], r["_row"]): r["nature"] for r in spark.read.parquet(path).collect()}
    times = {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if f.startswith("_file=")}
    sig = {(r["_file"], r["_row"]): r["_signature"] for r in m.collect()}
    batch = lambda nature, keys: spark.createDataFrame([(*k, sig.get(k, "x"), nature) for k in keys], "_file string, _row long, signature string, nature string")
    one, two = batch("真实", [("a b%", 0), ("a b%", 1), ("c", 9)]), batch("虚假", [("a b%", 1), ("c", 0)])
    status = lambda df: {(r["_file"], r["_row"]): r["status"] for r in df.collect()}
    assert status(verify.write_back(spark, path, one)) == {("a b%", 0): "ok", ("a b%", 1): "ok", ("c", 9): "not_found"}
    assert status(verify.write_back(spark, path, two)) == {("a b%", 1): "conflict", ("c", 0): "ok"}
    now = stored()
    assert len(now) == 9 and now["a b%", 0] == now["a b%", 1] == "真实" and now["c", 0] == "虚假" and now["c", 1] == "未校验"
    after = {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in times}
    assert after["_file=d"] == times["_file=d"] and after["_file=c"] != times["_file=c"]
    assert not [f for f in os.listdir(tmp_path) if "stage" in f]
    again = verify.write_back(spark, path, batch("中立", [("d", 0)]).withColumn("signature", F.lit("stale")))
    assert status(again) == {("d", 0): "conflict"} and os.stat(os.path.join(path, "_file=d")).st_mtime_ns == times["_file=d"]


def test_tokens_of_a_batch_come_in_slices(monkeypatch):
    """Only a slice's tokens are Python objects; nulls, empty and long texts keep their places."""
    import pyarrow as pa

    from riskweave.functions import segment

    texts, known = ["金木", None, "", "水火水火水火 abc", "石"] * 3, segment.Dictionary({"金木": 5, "水火": 3})
    for size in (1, 3, 1 << 18):
        monkeypatch.setattr(segment, "SLICE", size)
        assert segment.cut_texts(pa.array(texts, pa.string()), known.tokens).to_pylist() == [known.tokens(t) for t in texts]
    assert segment.cut_texts(pa.array([], pa.string()), known.tokens).to_pylist() == []


def test_classifier_is_fit_on_stored_rows(spark, monkeypatch):
    """Passes over the training rows shuffle nothing again."""
    from riskweave.operators import training
    from riskweave.plans import queries

    fit, seen = training.fit_classifier, []
    monkeypatch.setattr(training, "fit_classifier", lambda data: seen.append(data) or fit(data, iterations=1))
    queries.classifier_scores(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString() and not seen[0].isEmpty()
