"""Scoring runs that stop and go on, and calls that run side by side."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from riskweave import models
from riskweave.functions.text import signature
from riskweave.operators import batch
from riskweave.schema import COLUMNS


def table(spark, rows):
    df = spark.createDataFrame(rows, "_file string, _row long, content string, fake_probability string")
    return df.withColumns({c: F.lit("") for c in COLUMNS if c not in ("content", "fake_probability")}).withColumn("_signature", signature())


ROWS = [(f, k, "bad" if k == 5 else f"text {k}", "12.00" if k % 4 == 0 else "") for f in ("a", "b") for k in range(11)]


def test_a_stopped_run_goes_on(spark, tmp_path):
    m, calls = table(spark, ROWS), []
    model = lambda df: df.withColumn("score", F.when(F.col("content") == "bad", F.lit(None)).otherwise(F.length("content") * 10.0))

    def dying(df):
        calls.append(df.count())
        if len(calls) == 3:
            raise OSError
        return model(df)

    journal = batch.Journal(spark, str(tmp_path / "j"))
    with pytest.raises(OSError):
        batch.run_slices(m, dying, journal, size=4)
    half = {(r["_file"], r["_row"]): r["outcome"] for r in batch.resumed(m, journal).collect()}
    assert half["a", 5] == "failed" and half["a", 9] == "pending" and half["a", 4] == "skipped" and half["b", 1] == "done"
    assert batch.run_slices(m, model, journal, size=4) == 1
    assert batch.run_slices(m, model, journal, size=4) == 0
    entries = journal.entries()
    assert entries.count() == entries.select("_file", "_row").distinct().count() == 16
    whole = batch.scored(model(m), F.col("score"))
    key = lambda df: sorted((r["_file"], r["_row"], r["fake_probability"], r["outcome"]) for r in df.collect())
    assert key(batch.resumed(m, journal)) == key(whole)


def test_changed_rows_and_later_runs(spark, tmp_path):
    journal = batch.Journal(spark, str(tmp_path / "j"))
    assert journal.runs() == 0 and batch.run_slices(table(spark, ROWS).limit(0), lambda df: df, journal) == 0
    scored = lambda x: lambda df: df.withColumn("score", F.lit(x))
    batch.run_slices(table(spark, ROWS), scored(50.0), journal, True)
    changed = table(spark, [("a", 0, "new text", ""), *ROWS[1:]])
    assert batch.resumed(changed, journal, True).where("outcome = 'pending'").count() == 1
    assert batch.run_slices(changed, scored(60.0), journal, True) == 1
    assert batch.run_slices(changed, scored(float("nan")), journal, True, run=2) == 1
    got = {(r["_file"], r["_row"]): (r["fake_probability"], r["outcome"]) for r in batch.resumed(changed, journal, True).collect()}
    assert got["a", 0] == ("60.00", "done") and got["b", 3] == ("50.00", "done")  # the last valid score
    batch.run_slices(changed, scored(70.0), journal, True, run=3)
    assert {r["fake_probability"] for r in batch.resumed(changed, journal, True).collect()} == {"70.00"} and journal.runs() == 3


class _Slow(models.Chat):
    def __init__(self, seconds=0.25):
        self.seconds = seconds
        super().__init__(self._reply, timeout=5)

    def _reply(self, messages, options):
        text = messages[-1]["content"]
        time.sleep(30 if text == "stuck" else self.seconds)
        if text == "broken":
            raise OSError("secret")
        return json.dumps({"risk_score": len(text), "reason": text})


def test_calls_run_side_by_side(spark):
    texts = ["x" * (k + 1) for k in range(24)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, content string").coalesce(1)
    spark.range(1).mapInPandas(lambda it: it, "id long").collect()  # workers are up
    times, results = [], []
    for pool in (1, 8):
        began = time.time()
        results.append([tuple(r) for r in models.run_chat(df, _Slow, pool=pool).collect()])
        times.append(time.time() - began)
    assert results[0] == results[1] and [r[0] for r in results[1]] == list(range(24)) and all(r[3] for r in results[1])
    assert times[0] > 6 and times[1] < times[0] / 3


def test_a_late_call_is_a_failed_attempt(spark):
    df = spark.createDataFrame([("one",), ("stuck",), ("broken",), (None,)], "content string").coalesce(1)
    began = time.time()
    got = models.run_chat(df, _Slow, deadline=0.8).collect()
    assert time.time() - began < 15
    assert [(r["content"], r["ok"], r["score"]) for r in got] == [("one", True, 3.0), ("stuck", False, None), ("broken", False, None), (None, False, None)]
    with pytest.raises(models.Late):
        models.within(0.05, lambda: time.sleep(1))


def test_slices_of_a_run_read_stored_messages(spark):
    """A slice doesn't number and sign all messages again."""
    from riskweave.plans import queries

    m, journal = queries._stopped_and_resumed(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()
    assert journal.entries().count() == m.count() > 0
