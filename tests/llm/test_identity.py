"""Texts that hash alike in weak hashes, ids that come twice or not at all, and very large groups."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from cases import PASSAGE, STORY

from riskweave.llm import near_dup, substring
from riskweave.llm.near_dup import prefix_sizes

#: A word of 1,024 letters by the parity of the bits of their places, and its complement: alike in polynomials modulo 2**64.
PARITY = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
TWIN = PARITY.translate({97: 98, 98: 97})
OTHER = " ".join(f"third{i}" for i in range(80))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def around(word: str) -> str:
    return " ".join([*(f"a{i}" for i in range(30)), word, *(f"b{i}" for i in range(30))])


def test_alike_hashes_remove_and_link_nothing(spark):
    docs = table(spark, [(1, around(PARITY)), (2, around(TWIN)), (3, PARITY), (4, TWIN)])
    assert {r["n_removed"] for r in substring.remove_repeats(docs).collect()} == {0}
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in near_dup.near_duplicates(docs).collect())
    texts = [f"{around(w)} {w} {w}c {w}" for w in (PARITY, TWIN)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in pipeline.repeats(spark, docs, "").collect()} == dict(enumerate(texts))
    assert pipeline.near_duplicates(spark, docs, "").count() == 2


@pytest.mark.parametrize("group", [1 << 25, 2])
def test_repeats_where_ids_repeat_or_lack(spark, group):
    again, more = f"begin {PASSAGE} finish", f"other {PASSAGE} close {PASSAGE}"
    rows = [(5, again), (5, again), (5, "a b c"), (5, more), (7, PASSAGE), (None, PASSAGE), (None, f"no {PASSAGE} id"), (5, None), (None, OTHER), (None, f"{OTHER} x"), (8, STORY), (8, STORY), (8, f"{STORY} y")]
    want = Counter([(5, again), (5, again), (5, "a b c"), (5, more), (7, ""), (None, ""), (None, "no id"), (5, ""), (None, OTHER), (None, f"{OTHER} x"), (8, STORY), (8, STORY), (8, f"{STORY} y")])
    assert Counter((r["doc_id"], r["text"]) for r in substring.remove_repeats(table(spark, rows), group=group).collect()) == want


def test_links_where_ids_repeat_or_lack(spark):
    near = STORY.replace("word60", "changed")
    rows = [(5, STORY), (5, OTHER), (5, OTHER), (3, near), (None, STORY), (None, PASSAGE), (None, PASSAGE), (9, f"{OTHER} x"), (None, None), (4, None), (4, None)]
    want = Counter([(5, 3), (5, 5), (5, 5), (3, 3), (None, 3), (None, None), (None, None), (9, 5), (None, None), (4, 4), (4, 4)])
    found = near_dup.near_duplicates(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_prefixes_leave_no_link_out():
    for percent in (80, 85, 100):
        for n in range(1, 60):
            few, more = prefix_sizes(n, percent)
            for m in range(n, 60):
                least = next((c for c in range(n + 1) if 100 * c >= percent * (n + m - c)), None)
                if least is not None:  # disjoint prefixes would leave fewer than `least` in common
                    assert n - few < least and m - prefix_sizes(m, percent)[1] < least


def test_large_bucket_of_unlike_documents(spark):
    """Documents with a common frame, so that they share buckets, and a part of their own; pairs of them are near copies."""
    n = 4000
    frame = [f"frame{i}" for i in range(160)]
    rows = []
    for k in range(n):
        own = [f"own{k // 2}x{i}" for i in range(40)]
        rows.append((k, " ".join([*frame, *own[:-1], f"end{k}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = near_dup.near_duplicates(docs, bands=64, rows=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: k // 2 * 2 for k in range(n)}


def test_one_word_over_and_over(spark):
    docs = table(spark, [(k, " ".join(["same"] * (2000 + k))) for k in range(200)])
    found = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    assert found == {k: 2000 + k if k else 0 for k in range(200)}
