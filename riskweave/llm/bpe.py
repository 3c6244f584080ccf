"""BPE encoding and decoding with given vocabularies; nothing is trained here.

`WordCodec` encodes by forced-boundary splitting. A byte pair that occurs inside no
vocabulary token can never be merged, so the place between its bytes is a certain cut,
and fragments between cuts encode independently. White space is in no token: the first
cuts are at white space, and the fragments between are looked up, since most recur. An
unknown one is cut at its pre-token boundaries; these are looked up too, and an unknown
one is cut, whatever its script and length, at every forced pair; only the last fragment of a pre-token carries the end-of-word mark.
A text is normalised once, as a whole; fragments are encoded from their bytes. What the pieces encode to is
concatenated. Decoding concatenates the pieces' decodings in the same way.

Rows are documents of their own: doc_id may be null or come twice, repeated rows have equal
results. Null and empty texts have no ids; long texts are coded whole; an empty table gives
an empty one; other columns are not read. Every text has one encoding, so there are no ties.

`byte_encoder` encodes with a byte-level vocabulary file of the tokenizers library; the
merges run in tiktoken on the same vocabulary, which gives the same ids faster.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batch_of, slices, source

#: Fragments that a Python worker remembers; then it starts afresh.
REMEMBERED = 400_000
#: Bytes up to which plain Python finds the forced pairs of a pre-token sooner than numpy.
SHORT = 64
#: The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_PRE = regex.compile(WORD_PATTERN)
_OTHER = re.compile("[^\\x00-\\x1b\\x20-ɏ]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


_LETTERS = _byte_letters()
_BYTES = {c: b for b, c in enumerate(_LETTERS)}
#: Marks the end of a word; UTF-8 has no such byte.
_END = b"\xff"


class _Known(dict):
    """Words, or their pre-tokens, and what they encode and decode to; learns on a miss and starts afresh when full."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str | bytes) -> tuple[bytes, str]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.learn(word)
        return out


class WordCodec:
    """Encode and decode with a word-end BPE vocabulary file, giving the tokenizers library's ids and text."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        library = Tokenizer.from_file(path)
        self._normal, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        raw = {t: bytes(_BYTES[c] for c in t.removesuffix(end)) + _END * t.endswith(end) for t in vocab if t not in self.special}
        ranks = {raw[t]: i for t, i in vocab.items() if t in raw}
        ranks[_END] = max(ranks.values()) + len(self.special) + 1  # every byte with the mark is a token: never left alone
        self._bpe = tiktoken.Encoding("word-end", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._bpe._core_bpe.encode_single_piece
        #: never[a, b]: no token has the byte a followed by b.
        self.never = np.ones((256, 256), bool)
        for token in ranks:
            pair = list(token)
            self.never[pair[:-1], pair[1:]] = False
        self._forced = set(map(tuple, np.argwhere(self.never).tolist()))
        self._known, self._coded = _Known(self._learn), _Known(self._code)

    def fragments(self, pre_token: bytes) -> list[bytes]:
        """Cut a marked pre-token at its forced boundaries."""
        if len(pre_token) <= SHORT:
            cuts = [i for i, pair in enumerate(zip(pre_token, pre_token[1:]), 1) if pair in self._forced]
        else:
            raw = np.frombuffer(pre_token, np.uint8)
            cuts = (np.flatnonzero(self.never[raw[:-1], raw[1:]]) + 1).tolist()
        if not cuts:
            return [pre_token]
        return [pre_token[a:b] for a, b in zip([0, *cuts], [*cuts, len(pre_token)])]

    def _pre_tokens(self, word: str) -> list[bytes]:
        """The bytes of each pre-token; where Unicode versions may differ, the library's own."""
        if _OTHER.search(word):
            return [bytes(map(_BYTES.__getitem__, pre)) for pre, _ in self._split(word)]
        return [word.encode()] if word.isalpha() else [pre.encode() for pre in _PRE.findall(word)]

    def _code(self, pre_token: bytes) -> tuple[bytes, str]:
        """Ids and decoding; a space ends the decoding."""
        ids: list[int] = []
        for piece in self.fragments(pre_token + _END):
            ids += self._piece(piece)
        return array("I", ids).tobytes(), self.decode(ids) + " "

    def _learn(self, word: str) -> tuple[bytes, str]:
        coded = [self._coded[pre] for pre in self._pre_tokens(word)]
        return coded[0] if len(coded) == 1 else (b"".join([x[0] for x in coded]), "".join([x[1] for x in coded]))

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def _words(self, text: str) -> list[str]:
        if _OTHER.search(text):
            return [w for w in self._normal(text).split(" ") if w]
        return text.lower().split()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and their decoding."""
        found: list[tuple[bytes, str]] = []
        for part in self._specials.split(text) if self._specials and "<" in text else (text,):
            if part in self.special:
                found.append((array("I", [self.special[part]]).tobytes(), part + " "))
            elif part:
                found += map(self._known.__getitem__, self._words(part))
        return b"".join([x[0] for x in found]), "".join([x[1] for x in found])[:-1]


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def _coded(batches, path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    codec = word_codec(path)
    for part in slices(batches, "text"):
        ids, decoded = zip(*[codec.encode(t or "") for t in part["text"].to_pylist()])
        yield batch_of(schema, {"doc_id": part["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": decoded})


def encode_words(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian 32-bit) and decoded. Null and empty texts have no ids and decode to "". Needs no shuffle."""
    docs = source(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(lambda it: _coded(it, path), "doc_id long, n_tokens long, ids binary, decoded string")


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """A function from a text to its ids (numpy, 32 bits). Special tokens in the text get their own ids, as the library does by default."""
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(_BYTES[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
