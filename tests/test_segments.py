"""The stored index: any order of changes equals a new index, bounds skip blocks and lose no hit, versions are whole."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.functions.text import signature
from riskweave.operators import search, segments
from riskweave.operators.segments import Changes, Index
from riskweave.schema import COLUMNS

WORDS = ["flood", "the", "alarm", "of", "city", "rumour", "rare"]


def table(spark, texts: dict[str, list[str]]):
    rows = [(f, k, t) for f, ts in texts.items() for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "_file string, _row long, content string").repartition(3)
    return df.withColumns({c: F.lit("") for c in COLUMNS if c != "content"}).withColumn("_signature", signature())


def scores(texts: dict[str, list[str]], terms: list[str]) -> dict:
    """BM25 by the book."""
    docs = {(f, k): Counter(t.split()) for f, ts in texts.items() for k, t in enumerate(ts)}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / max(1, len(docs))
    df = {t: sum(t in c for c in docs.values()) for t in terms}
    out = {}
    for key, c in docs.items():
        parts = [math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / round(mean, 6))) for t in terms if c[t]]
        if parts:
            out[key] = round(sum(parts), 6)
    return out


def found(df) -> dict:
    return {(r["_file"], r["_row"]): round(r["score"], 6) for r in df.collect()}


def holds(index: Index, texts: dict[str, list[str]]) -> None:
    counts = Counter(t for ts in texts.values() for text in ts for t in set(text.split()))
    assert {r["term"]: r["df"] for r in index.terms().collect()} == counts
    assert {(r["_file"], r["doc_count"], r["total_length"]) for r in index.stats().collect()} == {(f, len(ts), sum(len(t.split()) for t in ts)) for f, ts in texts.items() if ts}
    for terms in (["flood"], ["rare", "the"]):
        assert found(search.indexed_scores(index, terms)) == scores(texts, terms)
        best = sorted(scores(texts, terms).items(), key=lambda x: (-x[1], x[0]))[:4]
        assert [((r["_file"], r["_row"]), r["score"]) for r in search.best_of_index(index, terms, 4, (1, 2)).hits.collect()] == best


def text(r: random.Random) -> str:
    return " ".join(r.choices(WORDS, [5, 20, 5, 20, 4, 3, 0.4], k=r.choice([0, 1, 3, 8, 15])))


@pytest.mark.parametrize("seed", [2])
def test_any_order_of_changes_equals_a_new_index(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(segments, "BLOCK", 4)
    r, index = random.Random(seed), Index(spark, str(tmp_path))
    texts = {f: [text(r) for _ in range(15)] for f in ("a", "b", "c")}
    assert index.update(table(spark, texts)) == Changes(45, 0)
    assert index.update(table(spark, texts)) == Changes(0, 0) and index.version() == 1
    steps = ["append", "edit", "delete", "file", "compact", "back"]
    r.shuffle(steps)
    before = {f: list(ts) for f, ts in texts.items()}
    for step in steps:
        f = r.choice(["a", "b"])
        if step == "append":
            texts[f] += [text(r) for _ in range(3)]
        elif step == "edit":
            texts[f][r.randrange(len(texts[f]))] = "rare edit"
        elif step == "delete":
            del texts[f][r.randrange(len(texts[f]))]
        elif step == "file":
            texts["c"] = []
        elif step == "back":
            texts["a"] = list(before["a"])
        else:
            index.compact()
            assert len(index.parts()) == 1
        index.update(table(spark, texts))
    holds(index, texts)
    index.compact()
    index.vacuum()
    assert len(index._names("parts")) == 1 == len(index._names("versions"))
    holds(index, texts)


def test_one_changed_row_writes_one_row(spark, tmp_path):
    texts = {"a": [f"flood number {k}" for k in range(200)], "b": ["the city"] * 50}
    index = Index(spark, str(tmp_path))
    index.update(table(spark, texts))
    texts["a"][77] = "alarm"
    assert index.update(table(spark, texts)) == Changes(1, 1)
    part = index.parts()[-1]
    assert spark.read.parquet(f"{tmp_path}/parts/{part.name}/docs").count() == 1 == spark.read.parquet(f"{tmp_path}/parts/{part.name}/gone").count()
    holds(index, texts)
    assert index.update(table(spark, {"b": ["the flood"] + ["the city"] * 49}), whole_files=True) == Changes(1, 1)
    texts["b"][0] = "the flood"
    holds(index, texts)


def test_empty_and_blank(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    assert index.version() == 0 and search.search_index(index, "flood").collect() == [] and index.docs().collect() == []
    index.compact()
    assert index.update(table(spark, {"a": []})) == Changes(0, 0)
    index.update(table(spark, {"a": ["flood", " "]}))
    assert found(search.search_index(index, "flood")).keys() == {("a", 0)}
    assert index.update(table(spark, {"a": ["", " "]})) == Changes(1, 1)
    assert search.search_index(index, "flood").collect() == [] and index.terms().collect() == []
    assert search.search_index(index, "").collect() == [] and search.best_of_index(index, ["flood"], 0).hits.collect() == []
    assert index.update(table(spark, {})) == Changes(0, 2)
    index.compact()
    assert index.parts() == [] and search.search_index(index, "flood").collect() == []


def test_bounds_skip_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    r = random.Random(5)
    texts = {"a": [" ".join(["the"] * r.choice([1, 1, 1, 2]) + ["of"] * r.randint(3, 40) + ["flood"] * (r.random() < 0.02) * 3) for _ in range(2000)]}
    index = Index(spark, str(tmp_path))
    index.update(table(spark, texts))
    for terms in (["the"], ["the", "flood"], ["of", "the", "flood"]):
        top = search.best_of_index(index, terms, 5, (8, 16))
        best = sorted(scores(texts, terms).items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [((x["_file"], x["_row"]), x["score"]) for x in top.hits.collect()] == best
        assert top.blocks == 250 and top.scored < (150 if "flood" in terms else 250), top
    assert search.best_of_index(index, ["flood", "the"], 5, (8, 16)).scored < 60


def test_two_writers(spark, tmp_path):
    one, other = Index(spark, str(tmp_path)), Index(spark, str(tmp_path))
    one.update(table(spark, {"a": ["flood"]}))
    parts = other.parts()
    one.update(table(spark, {"a": ["flood", "city"]}))
    with pytest.raises(RuntimeError, match="same time"):
        other._commit(2, parts)
    assert len(one.parts()) == 2 and one.terms().count() == 2


def test_blocks_are_sorted_in_small_tasks(spark, tmp_path, monkeypatch):
    """A task has the postings of so many tokens, whatever the session's partitions; runs that batches cut come whole."""
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "TOKENS", 100)
    texts = {f: ["the flood of the city"] * 30 for f in ("a", "b")}
    docs = segments.documents(table(spark, texts))
    assert segments.blocked(docs, 300 * 5).rdd.getNumPartitions() == 15
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = Index(spark, str(tmp_path))
        index.update(table(spark, texts))
        texts["b"][3] = "flood"
        index.update(table(spark, texts))
        holds(index, texts)
        index.compact()
        holds(index, texts)
        blocks = index.blocks().select("term", "_file", "_block", "n", "max_tf", "min_length", F.size("rows").alias("size")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({r[:3] for r in blocks}) == len(blocks) == 4 * 2 * 8 and all(r["n"] == r["size"] for r in blocks)
    assert [tuple(r)[3:6] for r in blocks if r[:3] == ("the", "b", 0)] == [(3, 2, 5)]


def test_texts_of_messages_are_shuffled_once(spark):
    """Labels and places are found without the texts, which no sort or window holds."""
    from riskweave.sources import testdata as td

    plan = td.messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    lines = [x for x in plan.splitlines() if "Sort [" in x or "Window [" in x]
    assert lines and not any("content" in x or "text" in x for x in lines)
    assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) <= 8


@pytest.mark.parametrize("most_words", [0, 100])
def test_compaction_sorts_rows_and_adds_counts(spark, tmp_path, monkeypatch, most_words):
    """Postings of all parts aren't taken out of their blocks and compared with tombstones one by one; sets of rows may be shuffled or broadcast."""
    from riskweave.operators import places

    monkeypatch.setattr(places, "MOST_WORDS", most_words)
    plans, write = {}, Index._write

    def watched(self, name, table, rows, *by):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()
        return write(self, name, table, rows, *by)

    monkeypatch.setattr(Index, "_write", watched)
    texts = {f: [f"flood the {k}" for k in range(150)] for f in ("a", "b")}
    index = Index(spark, str(tmp_path))
    index.update(table(spark, texts))
    for k in (0, 63, 64, 127, 149):
        texts["a"][k] = "alarm of alarm"
    assert index.update(table(spark, texts)) == Changes(5, 5)
    texts["a"] = [f"flood the {k}" for k in range(150)]
    texts["b"] = ["city"] * 70
    assert index.update(table(spark, texts)) == Changes(75, 155)
    holds(index, texts)
    index.compact()
    assert not any(word in plans[t] for t in ("blocks", "terms", "stats") for word in ("exists(", "Generate"))
    holds(index, texts)


def test_counts_of_rows_that_go(spark, tmp_path, monkeypatch):
    """They are taken as whole rows, whether these or those that stay are fewer; no term of a row becomes a row of a join or shuffle."""
    monkeypatch.setattr(segments, "COUNTED", 10)
    monkeypatch.setattr(segments, "TOKENS", 50)
    plans, write = [], Index._write

    def watched(self, name, table, rows, *by):
        plans.extend([rows._jdf.queryExecution().optimizedPlan().toString()] if table == "terms" else [])
        return write(self, name, table, rows, *by)

    monkeypatch.setattr(Index, "_write", watched)
    long = " ".join(f"w{k}" for k in range(300))
    texts = {"a": ["", " ", "é 漢字 ß é", long, "flood the rare"] * 20, "b": ["the", "rare 漢字 the"] * 3}
    index = Index(spark, str(tmp_path))
    index.update(table(spark, texts))
    holds(index, texts)
    texts["a"][3] = "rare"
    assert index.update(table(spark, texts)) == Changes(1, 1)
    holds(index, texts)
    texts["a"] = [t + " the" for t in texts["a"]]
    assert index.update(table(spark, texts)) == Changes(100, 100)
    holds(index, texts)
    assert len(plans) == 3 and not any("Generate" in p for p in plans)


def test_a_text_that_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "s", None), ("a", 1, "t", "flood")], "_file string, _row long, _signature string, content string")
    index = Index(spark, str(tmp_path))
    assert index.update(rows) == Changes(2, 0)
    assert sorted(r["length"] or 0 for r in index.docs().collect()) == [0, 1] and [tuple(r) for r in index.terms().collect()] == [("flood", 1)]
