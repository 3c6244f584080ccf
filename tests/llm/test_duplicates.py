"""Near duplicates, repeated passages and fingerprints against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import combinations
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import WORD, frame, groups, removed, rows
from pyspark.sql import functions as F

from riskweave.llm import fingerprint, near_dup, queries, substring
from riskweave.llm.words import Words


def variants(seed: int, n: int = 90) -> list[str]:
    """Copies, near copies and chains of them, and texts that share only some passages."""
    r, out = random.Random(seed), []
    passages = [" ".join(f"p{k}w{i}" for i in range(70)) for k in range(4)]
    while len(out) < n:
        words = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([3, 30, 120, 300]))]
        for _ in range(r.randint(1, 8)):
            out.append(" ".join(words))
            for _ in range(r.choice([0, 1, 1, 4, 9])):
                words[r.randrange(len(words))] = f"w{r.randint(0, 10**6)}"
        if r.random() < 0.6:
            out[-1] = f"{out[-1]} {r.choice(passages)} tail{r.randint(0, 3)} {r.choice(passages)[: r.randint(100, 400)]}"
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("percent", "block"), [(85, 256), (80, 8)])
def test_near_duplicates_brute_force(spark, percent, block):
    texts = variants(percent)
    found = near_dup.near_duplicates(frame(spark, texts), percent=percent, block=block).collect()
    want = groups([r[:2] for r in rows(texts)], percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and len(found) == len(texts)


def test_near_duplicates_odd_cases(spark):
    df = frame(spark)
    want = groups([r[:2] for r in rows()], 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()} == want
    assert near_dup.near_duplicates(df.limit(0)).collect() == []
    twice = near_dup.near_duplicates(df.union(df)).collect()
    assert len(twice) == 2 * df.count() and {(r["doc_id"], r["component_id"]) for r in twice} == {(d, c) for d, (_, c) in want.items()}


def test_near_duplicates_table(spark, sf, documents):
    found = queries.op7_near_duplicates(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == groups(documents, 85)


def test_sweep_gives_a_spanning_forest():
    texts = [" ".join(f"w{i}" for i in range(a, a + 100)) for a in (0, 4, 8, 12, 500, 504, 900)]
    sets = [np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint64) for t in texts]
    docs = np.arange(7)
    links = near_dup.spanning_links(docs, docs, sets, [t.encode() for t in texts], 1, 85)
    assert len(links) == 4 and {min(x) for x in links} <= {0, 1, 2, 4}


def test_a_large_component_meets_the_others_only(spark):
    n, few, block = 100_000, 5, 256
    tokens = spark.range(n + few).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("row"), F.when(F.col("id") < n, 1).otherwise(F.col("id")).cast("long").alias("component"), F.lit(100).cast("long").alias("bytes"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    met = near_dup.in_blocks(tokens, shared, block).cache()
    mains = -(-n // block)
    assert met.count() == n + few * (1 + mains)
    assert met.where("other > 0").groupBy("other").agg(F.count_if(F.col("component") > 1).alias("others")).where(f"others <> {few}").isEmpty()
    assert met.groupBy("one", "other").count().agg(F.max("count")).first()[0] < 2 * block


@pytest.mark.parametrize("large", [1, 9])
def test_blocks_bring_all_pairs_of_components_together(spark, large):
    r = random.Random(large)
    of = {k: r.randrange(12) if k % large == 0 else 99 for k in range(300)}
    tokens = spark.createDataFrame([(t, k, c, 10) for t in (1, 2) for k, c in of.items()], "token long, row long, component long, bytes long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.lit(30).alias("blocks"))
    together = {}
    for x in near_dup.in_blocks(tokens, shared, 10).collect():
        together.setdefault((x["token"], x["one"], x["other"]), []).append(x["row"])
    found = {(key[0], *pair) for key, rows_ in together.items() for pair in combinations(sorted(rows_), 2)}
    assert {(t, a, b) for t in (1, 2) for a, b in combinations(sorted(of), 2) if of[a] != of[b]} <= found


def test_circulant_coordinates_are_shifts():
    one = near_dup.signature(np.array([5], np.uint64), 64)
    next_cell = near_dup.signature(np.array([6], np.uint64), 64)
    assert (one[1:] == next_cell[:-1]).all()


@pytest.mark.parametrize("group", [1 << 25, 2])
def test_repeats_brute_force(spark, group):
    texts = variants(7)
    want = removed([r[:2] for r in rows(texts)], 50)
    for r in substring.remove_repeats(frame(spark, texts), group=group).collect():
        assert r["text"] == " ".join(want[r["doc_id"]]), r["doc_id"]
        assert r["n_words"] - r["n_removed"] == len(want[r["doc_id"]])


def test_repeats_odd_cases(spark):
    df = frame(spark)
    want = removed([r[:2] for r in rows()], 50)
    found = substring.remove_repeats(df).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {d: " ".join(w) for d, w in want.items()}
    assert {r["doc_id"]: r["n_words"] for r in found} == {d: len(WORD.findall(t or "")) for d, t, *_ in rows()}
    assert substring.remove_repeats(df.limit(0)).collect() == []
    assert len(substring.remove_repeats(df.union(df)).collect()) == 2 * df.count()


def test_repeats_table(spark, sf, documents):
    want = removed(documents, 50)
    found = {r["doc_id"]: r["kept_sha256"] for r in queries.op4_substring_dedup(spark, sf).collect()}
    assert found == {d: sha256(" ".join(w).encode()).hexdigest() for d, w in want.items()}


def test_words_as_the_pattern():
    texts = [t for _, t, *_ in rows()]
    w = Words(pa.array(texts, pa.string()))
    spans = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
    assert [spans[a:b] for a, b in zip(w.offsets, w.offsets[1:])] == [WORD.findall(t or "") for t in texts]


def edited(docs):
    docs = sorted((d, t or "") for d, t in docs)
    return {d: (t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], nxt) for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1])}


def form(text: str) -> bytes:
    """Written anew: compatibility forms, folded case, single spaces."""
    for step in (lambda t: normalize("NFKC", t), str.casefold, lambda t: normalize("NFKC", t)):
        text = step(text)
    return re.sub(r"\s+", " ", text).strip().encode()


def held(found, docs):
    want, groups = edited(docs), {}
    for d, t in sorted(docs):
        groups.setdefault(form(t or ""), d)
    assert sorted(r["doc_id"] for r in found) == sorted(want)
    for r in found:
        text, changed, after = want[r["doc_id"]]
        forms = [form(x) for x in (text, changed, after)]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha256(changed.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == [xxhash.xxh3_128(f).hexdigest() for f in forms[:2]]
        assert [r["near_edited"], r["near_next"]] == [float(forms[0] == f) for f in forms[1:]]
        assert r["group_id"] == groups[forms[0]]


def test_fingerprints_odd_cases(spark):
    held(fingerprint.edited_fingerprints(frame(spark)).collect(), [r[:2] for r in rows()])
    assert fingerprint.edited_fingerprints(frame(spark).limit(0)).collect() == []
    held(fingerprint.edited_fingerprints(frame(spark, ["alone text"])).collect(), [(1, "alone text")])


def test_fingerprints_table(spark, sf, documents):
    held(queries.op8_fingerprints(spark, sf).collect(), documents)


def test_canonical_folds_case_space_and_forms():
    assert fingerprint.canonical("  Straße\tﬁne ") == fingerprint.canonical("STRASSE fine") == b"strasse fine"
    assert fingerprint.canonical("é") == fingerprint.canonical("É")


def test_equal_groups_compare_bytes(spark, monkeypatch):
    texts = ["A b", "a  B", "c", "a b", None, "", "d d"]
    found = fingerprint.edited_fingerprints(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["group_id"] for r in found} == {1: 1, 4: 1, 7: 7, 10: 1, 13: 13, 16: 13, 19: 19}
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "A B"), (4, "C"), (5, "d")], "doc_id long, text string")
    # As if all of them had one fingerprint: the bytes still tell them apart.
    printed = docs.selectExpr("doc_id", "cast(repeat('x', 16) AS binary) AS fingerprint", "substring(unhex(sha2(lower(text), 256)), 1, 16) AS form")
    forms = fingerprint._forms
    alike = lambda batches, bits: (b.set_column(1, "fingerprint", pa.array([b"x" * 16] * b.num_rows)) for b in forms(batches, ~np.zeros_like(bits)))
    monkeypatch.setattr(fingerprint, "_forms", alike)
    assert {r["doc_id"]: r["group_id"] for r in fingerprint.equal_groups(docs, printed).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_fingerprints_where_ids_repeat_or_lack(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "A"), (3, "a"), (3, "a"), (3, "b"), (4, None)], "doc_id long, text string").repartition(3)
    found = fingerprint.edited_fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["group_id"]) for r in found) == Counter((d, xxhash.xxh3_128(f).hexdigest(), g) for d, f, g in [(None, b"a", 3), (None, b"a", 3), (3, b"a", 3), (3, b"a", 3), (3, b"b", 3), (4, b"", 4)])
