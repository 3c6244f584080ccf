"""Repeated rows, repeated doc_ids and rows without doc_id in the stages of the pipeline."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from cases import PASSAGE, STORY

OTHER = " ".join(f"third{i}" for i in range(80))
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def found(df) -> Counter:
    assert tuple(df.columns) == COLUMNS
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, STORY, "a"), (1, STORY, "a"), (1, STORY, "b"), (1, OTHER, "a"), (2, STORY, "a"), (None, STORY, "a"), (None, PASSAGE, "a"), (None, PASSAGE, "a"), (3, "some words", "a")]
    want = Counter([(1, STORY, "a"), (1, OTHER, "a"), (None, PASSAGE, "a"), (3, "some words", "a")])
    assert found(pipeline.near_duplicates(spark, table(spark, rows), "")) == want


def test_repeats_of_odd_rows(spark):
    again, more = f"begin {PASSAGE} finish", f"other {PASSAGE} close"
    rows = [(1, PASSAGE, "a"), (5, again, "a"), (5, again, "a"), (5, again, "b"), (5, STORY, "a"), (5, more, "a"), (None, f"no {PASSAGE} id", "a"), (None, OTHER, "a"), (7, PASSAGE, "a")]
    want = Counter([(1, PASSAGE, "a"), (5, "begin finish", "a"), (5, "begin finish", "a"), (5, "begin finish", "b"), (5, STORY, "a"), (5, "other close", "a"), (None, "no id", "a"), (None, OTHER, "a")])
    assert found(pipeline.repeats(spark, table(spark, rows), "")) == want


CLASHES = ("rest", "_rest", "_document", "_document_", "_id", "_ID_", "_digest", "_n", "row", "kept", "version", "doc", "component_id", "n_removed", "a.b", "least")


@pytest.mark.parametrize("repeated", [False, True])
def test_columns_of_any_name_stay_with_their_rows(spark, repeated):
    texts = [(1, STORY), (2, f"begin {PASSAGE} finish"), (3, f"other {PASSAGE} close"), (4, OTHER), (5, STORY)]
    rows = texts + texts[1:2] * repeated
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES) + ", more map<string,string>"
    df = spark.createDataFrame([(d, t, "en", "s", len(t), *(f"{c} {d}" for c in CLASHES), {"k": str(d)}) for d, t in rows], schema)
    want = {"near_duplicates": {1: STORY, 2: rows[1][1], 4: OTHER}, "repeats": {1: STORY, 2: rows[1][1], 3: "other close", 4: OTHER}}
    for name, stage in pipeline.STAGES[:3]:
        after = stage(spark, df, "")
        assert after.dtypes == df.dtypes
        found = after.collect()
        assert all([r[c] for c in CLASHES] == [f"{c} {r['doc_id']}" for c in CLASHES] and r["more"] == {"k": str(r["doc_id"])} for r in found)
        if name in want:
            assert {r["doc_id"]: r["text"] for r in found} == want[name]
            assert len(found) == len(want[name]) + (repeated and name == "repeats")
    assert pipeline.pack(spark, df, "").count() >= len(rows)
