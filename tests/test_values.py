"""Parsing and normalising, row by row against the plain rules."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.functions import risk, text, values


def _each(spark, items, column, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def _float(t):
    try:
        return float(t)
    except ValueError:
        return None


def test_number_follows_float(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text("0123456789+-._eE nafityINF", max_size=8), min_size=400, max_size=400))
    def run(items):
        items += ["1_000", "+nan", "-inf", "Infinity", "1d", "1__0", "_1", ".5", "5.", "", " 7 ", "1e5", "-nan", "1f"]
        for t, got in zip(items, _each(spark, items, values.number)):
            want = _float(t)
            assert got == want or (want is not None and got is not None and math.isnan(want) and math.isnan(got)), t

    run()


def test_probability_rounds_the_binary_value_and_clamps(spark):
    items = ["0.125", "0.285", "1.005", "2.675", "nan", "inf", "-inf", "101", "-1", "", "  ", "x", None, "99.999", "1_0"]
    want = [f"{max(0.0, min(100.0, float(t))):.2f}" if t and t.strip() and _float(t) is not None else ("" if not t or not t.strip() else None) for t in items]
    assert _each(spark, items, values.probability) == want


def test_time_formats(spark):
    items = ["2024-03-05 07:08:09", "2024-3-5T7:8:9", "2024-03-05T07:08", "2024-3-5", "2024-02-30", "2024-03-05 x", "", None]
    assert _each(spark, items, values.time) == ["2024-03-05 07:08:09"] * 2 + ["2024-03-05 07:08:00", "2024-03-05 00:00:00", None, None, "", ""]


def test_as_int_and_page(spark):
    assert _each(spark, ["3.9", "-3.9", "x", "", "nan", "inf", "1e3"], values.as_int) == [3, -3, 0, 0, 0, 0, 1000]
    assert _each(spark, ["2", "0", "-1", "x", None, "2.5"], values.page_number) == [2, 1, 1, 1, 1, 1]


def test_nature_and_names(spark):
    assert _each(spark, [" 虚假 ", "other", None], values.nature) == ["虚假", "未校验", "未校验"]
    assert _each(spark, ["a.csv", "A.CSV", "../a.csv", "a\\b.csv", "a.txt", ""], values.csv_name) == [True, True, False, False, False, False]


@pytest.mark.parametrize(("score", "want"), [(0, "low"), (39.999, "low"), (40, "medium"), (69.999, "medium"), (70, "high"), (100, "high")])
def test_bands(spark, score, want):
    assert _each(spark, [float(score)], risk.level, "double") == [want]


def test_valid_scores(spark):
    assert _each(spark, [0.0, 100.0, -0.001, 100.001, float("nan"), float("inf"), None], risk.valid_score, "double") == [0.0, 100.0, None, None, None, None, None]


def test_stored_level(spark):
    assert _each(spark, ["", None, "x", "39.99", "70", "nan"], risk.stored_level) == ["待检测", "待检测", "low", "low", "high", "low"]


def test_tokenizers(spark):
    items = ["Hello, WORLD 42!", "今天天气 ok", "", "!!"]
    assert _each(spark, items, text.words) == [["hello", "world", "42"], ["今天天气", "ok"], [], []]
    assert _each(spark, items, text.han_bigrams) == [["hello", "world", "42"], ["今天", "天天", "天气", "ok"], [], []]


def test_truncated(spark):
    long = "word " * 60
    got = _each(spark, ["x" * 145, "x" * 146, long, "😀" * 146], text.truncated)
    assert got[0] == "x" * 145 and got[1] == "x" * 137 + "..." and got[2].endswith("word...") and got[3] == "😀" * 137 + "..."


def test_signature_counts_null_as_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", "")], "content string, nature string")
    got = [r[0] for r in rows.select(text.signature(("content", "nature"))).collect()]
    assert got[0] == got[1] and len(got[0]) == 16


def test_softmax(spark):
    assert [round(x, 6) for x in _each(spark, [[0.0, 0.0]], risk.softmax, "array<double>")[0]] == [0.5, 0.5]
