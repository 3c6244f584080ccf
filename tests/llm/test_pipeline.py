"""Each stage of the corpus pipeline on its own input."""

from __future__ import annotations

import corpus_pipeline as pipeline
from cases import frame, groups, removed, rows


def test_stages(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeats", "pack"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf)
        after = docs.collect()
        if name == "pack":
            assert {r["doc_id"] for r in after} == set(before)
            continue
        assert docs.dtypes == columns
        texts = {r["doc_id"]: r["text"] for r in after}
        assert set(texts) <= set(before)
        if name == "language":
            assert len(texts) > 0.9 * len(before)
        elif name == "near_duplicates":
            assert texts == {d: before[d] for d, (_, c) in groups(list(before.items()), 80).items() if d == c}
        else:
            want = {d: " ".join(w) for d, w in removed(list(before.items()), 50).items()}
            assert {d: " ".join(t.split()) for d, t in texts.items()} == {d: t for d, t in want.items() if t}


def test_odd_documents_pass_every_stage(spark, sf):
    docs = frame(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.collect()
    assert "sequence_id" in docs.columns
    empty = frame(spark).limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.collect() == []


def test_rows_are_those_of_documents():
    assert len({r[0] for r in rows()}) == len(rows())
