"""Word BPE on every script: normalised once, cut at forced pairs, encoded from bytes."""

from __future__ import annotations

import random

import pytest
from test_tokens import WORDS, library, raw

from riskweave.llm import bpe

SCRIPTS = {"cyrillic": (0x400, 0x52F), "greek": (0x370, 0x3FF), "arabic": (0x600, 0x6FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3), "kana": (0x3040, 0x30FF), "devanagari": (0x900, 0x97F), "marks": (0x300, 0x36F), "dashes": (0x2010, 0x2060), "emoji": (0x1F300, 0x1F9FF), "latin": (0x20, 0x24F)}


def same(codec, coder, text: str) -> None:
    ids = coder.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == (raw(ids), coder.decode(ids, skip_special_tokens=False)), ascii(text)


@pytest.mark.parametrize("text", ["H̱adith", "T̈a", "x H̱ T̈ W̊ Y̊ J̌", "H̱<|endoftext|>T̈"])
def test_marks_that_compose_only_in_lower_case(text):
    same(bpe.word_codec(WORDS), library(WORDS), text)


@pytest.mark.parametrize("script", SCRIPTS)
def test_scripts(script):
    r, coder, codec = random.Random(script), library(WORDS), bpe.word_codec(WORDS)
    first, last = SCRIPTS[script]
    for _ in range(1000):
        letters = [*(chr(r.randint(first, last)) for _ in range(12)), " ", "H", "T", "a", "̱", "̈", "’", "1"]
        same(codec, coder, "".join(r.choices(letters, k=r.randint(1, 60))))


def test_vocabulary_joined():
    r, coder, codec = random.Random(8), library(WORDS), bpe.word_codec(WORDS)
    tokens = [bytes(bpe._BYTES[c] for c in t.removesuffix("</w>")).decode(errors="ignore") for i, t in codec.tokens.items() if t not in codec.special]
    for _ in range(5000):
        same(codec, coder, "".join(r.choices(tokens, k=r.randint(1, 6))))


def test_every_script_is_cut_at_forced_pairs(monkeypatch):
    codec = bpe.WordCodec(WORDS)
    cut, whole = [], codec.fragments
    monkeypatch.setattr(codec, "fragments", lambda pre: cut.append(pre) or whole(pre))
    codec.encode("word слово λόγος 中文")
    assert [c.removesuffix(b"\xff").decode() for c in cut] == ["word", "слово", "λόγος", "中文"]


def test_pre_tokens_are_encoded_once_whatever_stands_beside_them(monkeypatch):
    codec, coder = bpe.WordCodec(WORDS), library(WORDS)
    seen, piece = [], codec._piece
    monkeypatch.setattr(codec, "_piece", lambda raw: seen.append(bytes(raw)) or piece(raw))
    for text in ("thheingble thheingble. (thheingble), Thheingble's", "слово слово. «слово»", "a" * 500 + " " + "a" * 500 + ".", "x1 x. 1."):
        same(codec, coder, text)
    assert len(seen) == len(set(seen))
