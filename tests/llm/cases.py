"""Documents with every odd case, and brute-force versions of the corpus operators."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i}" for i in range(60))
STORY = " ".join(f"word{i}" for i in range(120))
NEAR = STORY.replace("word60", "other")

TEXTS: list[str | None] = [
    None, "", " \t\n ", "one", "One two three", "one  two\tthree", STORY, STORY, NEAR, STORY.upper(),
    f"before {PASSAGE} after", f"start {PASSAGE} end {PASSAGE}", PASSAGE, " ".join(["same"] * 200), " ".join(["same"] * 130),
    "Ünïcödé “quotes” – dash … naïve ﬁne Å Å İstanbul ẞ ß", "日本語のテキスト 中文 한국어 emoji 👩‍👩‍👧 end", "a\x00b\x1cc\x85d\xa0e f​g",
    "<|endoftext|> in <|startoftext|> text", "don't we'll I'd 12345 $%&*()!!! ...", "x" * 3000, "é" * 500, "12 34 !?",
    " ".join(f"long{i % 977}x{i}" for i in range(20000)),
]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("key", "length", "_rank", "digest", "shard", "ids", "payload", "chunks", "prefix", "component")),
])


def rows(texts=TEXTS) -> list[tuple]:
    return [(3 * i + 1, t, None if i % 5 == 0 else "en", None, None if t is None else len(t), *["clash"] * 10) for i, t in enumerate(texts)]


def frame(spark, texts=TEXTS, parts: int = 3):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(parts)


def removed(docs: list[tuple[int, str | None]], width: int) -> dict[int, list[str]]:
    """The kept words of each document."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    least: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = [x for x, g in zip(w, gone) if not g]
    return out


def shingles(text: str | None) -> set:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(docs: list[tuple[int, str | None]], percent: int) -> dict[int, tuple[int, int]]:
    """(set size, component) of each document, from all pairs."""
    sets, parent = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}
