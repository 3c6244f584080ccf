"""CSV folders: matching by name, quoting, missing values, row places, staged rewrites, index upkeep."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.functions.text import signature
from riskweave.operators import search, segments, verify
from riskweave.schema import COLUMNS
from riskweave.sources import messages as src


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b%.csv").write_text('source,content,extra,nature\ns1,"two\nlines ""quoted""",x,真实\n\nNA,null,,虚假\n" NA ",none,,\n', encoding="utf-8")
    (tmp_path / "消息.csv").write_text("﻿" + ",".join(COLUMNS) + "\nrelease the license,未校验,12,x,,\n,,,,,\n", encoding="utf-8")
    (tmp_path / "z.csv").write_text("")
    (tmp_path / "note.txt").write_text("no")
    return str(tmp_path)


def test_listing_and_guard(spark, folder):
    assert src.list_tables(spark, folder) == ["a b%.csv", "z.csv", "消息.csv"]
    assert src.list_tables(spark, folder + "/none") == []
    for bad in ("../x.csv", "note.txt", ""):
        with pytest.raises(ValueError):
            src.checked_name(spark, folder, bad)
    with pytest.raises(FileNotFoundError):
        src.checked_name(spark, folder, "missing.csv")


def test_union_matches_by_name(spark, folder):
    rows = src.load_all(spark, folder).orderBy("_file", "_row").collect()
    got = [(r["_file"], r["_row"], r["content"], r["nature"], r["source"], r["fake_probability"]) for r in rows]
    assert got == [
        ("a b%.csv", 0, 'two\nlines "quoted"', "真实", "s1", ""), ("a b%.csv", 1, "", "虚假", "", ""), ("a b%.csv", 2, "none", "", " NA ", ""),
        ("消息.csv", 0, "release the license", "未校验", "x", "12"), ("消息.csv", 1, "", "", "", ""),
    ]


def test_rewrite_keeps_rows(spark, folder):
    before = src.read_table(spark, folder, "a b%.csv").orderBy("_row").collect()
    src.write_table(spark.createDataFrame(before), folder, "copy.csv")
    after = src.read_table(spark, folder, "copy.csv").orderBy("_row").collect()
    assert [r["_signature"] for r in before] == [r["_signature"] for r in after]
    src.ensure_folder(spark, folder)
    assert src.read_table(spark, folder, "manual.csv").count() == 0


def test_edits_move_rows_up(spark, folder):
    m = src.read_table(spark, folder, "a b%.csv")
    sig = {r["_row"]: r["_signature"] for r in m.collect()}
    edits = spark.createDataFrame([("a b%.csv", 0, sig[0]), ("a b%.csv", 1, "stale"), ("a b%.csv", 9, "")], "_file string, _row long, signature string")
    assert {r["_row"]: r["status"] for r in verify.statuses(m, edits).collect()} == {0: "ok", 1: "conflict", 9: "not_found"}
    assert [(r["_row"], r["content"]) for r in verify.delete(m, edits).orderBy("_row").collect()] == [(0, ""), (1, "none")]


def test_update_tells_null_from_empty(spark, folder):
    m = src.read_table(spark, folder, "a b%.csv")
    edits = spark.createDataFrame([("a b%.csv", 0, "", None, "")], "_file string, _row long, signature string, content string, source string")
    row = verify.update(m, edits).where("_row = 0").first()
    assert row["content"].startswith("two") and row["source"] == ""


def test_states(spark, folder):
    m = src.load_all(spark, folder)
    none, all_ = spark.createDataFrame([], "key string"), verify.unverified(m).select("key")
    assert verify.state(m, none).first()["state"] == "ready"
    assert verify.state(m, all_).first()["state"] == "all_skipped"
    assert verify.state(m.where(F.col("nature") != "未校验"), none).first()["state"] == "all_verified"


def test_index_upkeep(spark, folder, tmp_path):
    m, stored = src.load_all(spark, folder), segments.Index(spark, str(tmp_path / "index"))
    assert stored.update(m) == (5, 0)
    assert stored.update(m) == (0, 0)
    terms = search.query_terms(spark, "License license two")
    assert sorted(terms) == ["license", "two"]
    one = {(r["_file"], r["_row"]): round(r["score"], 9) for r in search.scores(m, terms).collect()}
    two = {(r["_file"], r["_row"]): round(r["score"], 9) for r in search.indexed_scores(stored, terms).collect()}
    assert one == two and len(one) == 2
    assert search.search(m, "license").count() == 1 and search.search(m, "").count() == 0 and search.search(m, "license", 0).count() == 0
    changed = m.withColumn("content", F.when(F.col("_file") == "消息.csv", "new words").otherwise(F.col("content"))).withColumn("_signature", signature())
    assert stored.update(changed) == (2, 2)
    assert stored.update(m.where(F.col("_file") == "消息.csv")) == (2, 5)
    assert [r["_file"] for r in stored.stats().collect()] == ["消息.csv"]

def test_stop_words(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("# comment\nThe\n\n of \n", encoding="utf-8")
    assert {r[0] for r in src.stop_words(spark, str(tmp_path / "stop.txt")).collect()} == {"the", "of"}
    assert src.stop_words(spark, str(tmp_path / "none.txt")).count() == 0
