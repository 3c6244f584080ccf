"""Packing, BPE coding and token files against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, frame, rows
from tokenizers import Tokenizer

from riskweave.llm import bpe, packing, queries, token_files
from riskweave.llm.common import new_folder

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def raw(ids) -> bytes:
    return array("I", ids).tobytes()


def best_fit_decreasing(lengths, capacity: int) -> int:
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def few(sequences: int, lengths, capacity: int) -> bool:
    """As few as best-fit decreasing one by one, which the bulk sweeps may beat, or 0.3 percent more."""
    return -(-sum(lengths) // capacity) <= sequences <= best_fit_decreasing(lengths, capacity) * 1.003


def held(found, docs, capacity: int) -> None:
    coder, by_doc, by_sequence = library(BYTE), defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for doc, text in docs:
        ids, at = [*coder.encode(text or "", add_special_tokens=False).ids, 2], 0
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(raw(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // capacity)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert few(len(by_sequence), [r["length"] for r in found], capacity)


def test_packing_odd_cases(spark):
    held(packing.pack_documents(frame(spark), BYTE).collect(), [r[:2] for r in rows()], 1024)
    assert packing.pack_documents(frame(spark).limit(0), BYTE).collect() == []


def test_packing_table(spark, sf, documents):
    held(queries.op1_best_fit_packing(spark, sf).collect(), documents, 1024)


def test_packing_of_equal_rows_and_hot_lengths(spark):
    df = spark.range(3000).selectExpr("0L AS k", "CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE 1 + id % 60 END AS int) AS length")
    found = packing.pack(df, capacity=64).collect()
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(found) == 3000
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert few(len(by), [r["length"] for r in found], 64)


@pytest.mark.parametrize("bad", [0, 65, None])
def test_packing_refuses_bad_lengths(spark, bad):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, bad)], "k long, length int"), capacity=64)


def test_sweeps_give_each_gap_its_nearest_predecessor():
    r = random.Random(1)
    for _ in range(300):
        pieces, gaps = (sorted(r.randint(1, 12) for _ in range(r.randint(0, 12))) for _ in range(2))
        free, want = list(pieces), []
        for g in gaps:
            fit = [p for p in free if p <= g]
            if fit:
                free.remove(max(fit))
                want.append((max(fit), g))
        ours, theirs = packing.successors(np.array(pieces, int), np.array(gaps, int))
        assert sorted((pieces[i], gaps[j]) for i, j in zip(ours, theirs)) == sorted(want)
        assert len(set(ours.tolist())) == len(ours) and len(set(theirs.tolist())) == len(theirs)
        met = packing.meetings(*({n: x.count(n) for n in set(x)} for x in (pieces, gaps)))
        assert sorted((p, g) for p, _, g, _, n in met for _ in range(n)) == sorted(want)
        for size, at in ((0, 1), (2, 3)):
            taken = sorted((m[size], m[at] + k) for m in met for k in range(m[4]))
            assert len(set(taken)) == len(taken)


@pytest.mark.parametrize("rows_of_range", [100, 700, 10**6])
def test_packing_in_ranges(spark, rows_of_range):
    df = spark.range(1500).selectExpr("id AS sequence_id", "'x' AS _kind", "CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE 1 + id * 37 % 60 END AS int) AS length")
    found = packing.pack(df.repartition(4), capacity=64, rows_of_range=rows_of_range).toDF("id", "_kind", "length", "sequence_id", "offset").collect()
    assert sorted(r["id"] for r in found) == list(range(1500))
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert few(len(by), [r["length"] for r in found], 64)


def test_word_codec_odd_cases(spark):
    coder = library(WORDS)
    found = {r["doc_id"]: r for r in bpe.encode_words(frame(spark), WORDS).collect()}
    for doc, text, *_ in rows():
        ids = coder.encode(text or "", add_special_tokens=False).ids
        assert bytes(found[doc]["ids"]) == raw(ids), text and text[:60]
        assert found[doc]["n_tokens"] == len(ids)
        assert found[doc]["decoded"] == coder.decode(ids, skip_special_tokens=False), text and text[:60]
    assert bpe.encode_words(frame(spark).limit(0), WORDS).collect() == []


def test_word_codec_table(spark, sf, documents):
    coder = library(WORDS)
    found = {r["doc_id"]: r for r in queries.op3_bpe_codec(spark, sf).collect()}
    assert set(found) == {d for d, _ in documents}
    for doc, text in documents:
        ids = coder.encode(text or "", add_special_tokens=False).ids
        assert found[doc]["ids_sha256"] == sha256(raw(ids)).hexdigest()
        assert found[doc]["decoded_sha256"] == sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_codec_random_text():
    r, coder, codec = random.Random(5), library(WORDS), bpe.word_codec(WORDS)
    letters = [*"abcdefgh  \t\n'’.,!?123", "\x85", "\xa0", " ", "\x1f", "é", "É", "é", "ß", "ẞ", "İ", "ſ", "ﬁ", "中", "한", "👍", "‍", "Σ", "ς", "ǅ", "ɏ", "ɐ", "﻿", "\x00", "½", "²", "'S", "'ll"]
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randint(1, 40)))
        ids = coder.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == (raw(ids), coder.decode(ids, skip_special_tokens=False)), ascii(text)


def test_forced_boundaries_are_certain():
    codec, r = bpe.word_codec(WORDS), random.Random(6)
    for _ in range(500):
        word = "".join(r.choices("abcdeqxzjkéñü0ßæ", k=r.randint(1, 60))).encode() + b"\xff"
        parts = codec.fragments(word)
        assert b"".join(parts) == word
        assert sum((codec._piece(p) for p in parts), []) == codec._piece(word)


def test_byte_encoder_random_text():
    r, coder, encode = random.Random(7), library(BYTE), bpe.byte_encoder(BYTE)
    letters = [*"abcdefgh   \t\n\r'.,!?123", "\x85", "\xa0", " ", "é", "é", "中", "👍", "\x00", "'s", "'ll", "<|endoftext|>", "½"]
    for text in [t for t in TEXTS if t is not None] + ["".join(r.choices(letters, k=r.randint(1, 40))) for _ in range(3000)]:
        assert encode(text).tolist() == coder.encode(text, add_special_tokens=False).ids, ascii(text[:80])


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    ids[::2] %= 50257
    assert (token_files.ids_of(token_files.planes_of(ids, kind), n, kind) == ids).all()


def in_order(docs) -> list[tuple]:
    coder, start, out = library(BYTE), 0, []
    for doc, text in sorted(docs):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(raw(ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files_odd_cases(spark, kind):
    files = token_files.write_token_files(frame(spark), BYTE, new_folder(spark, "t"), kind=kind)
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_files.read_token_files(files).collect())
    assert found == in_order([r[:2] for r in rows()])
    empty = token_files.write_token_files(frame(spark).limit(0), BYTE, new_folder(spark, "t"))
    assert token_files.read_token_files(empty).collect() == []


def test_token_files_table(spark, sf, documents):
    assert sorted(tuple(r) for r in queries.op5_token_files(spark, sf).collect()) == in_order(documents)
