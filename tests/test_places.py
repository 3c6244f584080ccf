"""Rows that are deleted, and those behind them, are found without moving a message."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.operators import places, verify


@pytest.mark.parametrize("most_words", [0, 1000])
def test_rows_move_up_by_the_rows_deleted_before(spark, monkeypatch, most_words):
    monkeypatch.setattr(places, "MOST_WORDS", most_words)
    n = 66_000  # over the border of a range
    gone = {"a": {0, 1, 62, 63, 64, 65, 127, 128, 1000, 65_535, 65_536, n - 1}, "b": set()}
    rows = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("_file"), F.col("id").alias("_row"), F.concat(F.lit("text "), "id").alias("content"), F.lit("s").alias("_signature"))
    edits = spark.createDataFrame([("a", k, "") for k in gone["a"]] + [("b", 5, "stale"), ("c", 1, "")], "_file string, _row long, signature string")
    left = verify.delete(rows, edits)
    assert {f: [int(t[5:]) for t in (r["content"] for r in left.where(F.col("_file") == f).orderBy("_row").collect())] for f in gone} == {f: [k for k in range(n) if k not in g] for f, g in gone.items()}
    places_ = left.groupBy("_file").agg(F.min("_row"), F.max("_row"), F.count_distinct("_row")).orderBy("_file").collect()
    assert [tuple(r) for r in places_] == [("a", 0, n - 13, n - 12), ("b", 0, n - 1, n)]
    if most_words:
        plan = left._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not any("content" in x for x in plan if "Exchange" in x or "Sort [" in x or "Window [" in x)
