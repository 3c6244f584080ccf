"""Segmentation of Han text by a dictionary of word counts.

Every run of Han characters is a graph whose edges are the dictionary's words in it, and its
single characters. The most probable path is the one with the greatest sum of log shares of
the counts, found from the end of the run backwards, each place once; of equal ones the one
whose first word is longer. A character that is no word of the dictionary counts as one seen
once. Runs of other letters and digits are words as they are, in lower case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tokenizer

#: Words of a dictionary at most, as it goes with every task.
MOST_WORDS = 1_000_000
#: Characters whose tokens are held as Python objects at a time.
SLICE = 1 << 18
#: The blocks of Han characters.
_HAN = "々〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_RUN = re.compile(rf"[{_HAN}]+|[^\W_{_HAN}]+")
_IS_HAN = re.compile(rf"[{_HAN}]")


class Dictionary:
    def __init__(self, counts: dict[str, int]):
        counts = {w: n for w, n in counts.items() if w and n > 0}
        self.total = math.log(sum(counts.values()) or 1)
        self.shares = {w: math.log(n) - self.total for w, n in counts.items()}
        self.longest: dict[str, int] = {}
        for w in counts:
            self.longest[w[0]] = max(self.longest.get(w[0], 1), len(w))

    def path(self, run: str) -> list[str]:
        """The most probable words of a run of Han characters."""
        n = len(run)
        best, step = [0.0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i], step[i] = -math.inf, 1
            for k in range(min(self.longest.get(run[i], 1), n - i), 0, -1):
                share = self.shares.get(run[i : i + k], -self.total if k == 1 else None)
                if share is not None and share + best[i + k] > best[i]:
                    best[i], step[i] = share + best[i + k], k
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out

    def tokens(self, text: str | None) -> list[str]:
        out: list[str] = []
        for run in _RUN.findall((text or "").lower()):
            out += self.path(run) if _IS_HAN.match(run) else [run]
        return out


def cut_texts(texts: pa.Array, tokens: Callable[[str | None], list[str]]) -> pa.Array:
    """The tokens of a batch of texts; no more than those of one long text, or of SLICE characters, are Python objects at a time."""
    kind = pa.list_(pa.string())
    done, waiting, size = [pa.array([], kind)], [], 0
    for text in texts:
        waiting.append(tokens(text := text.as_py()))
        size += len(text or "")
        if size >= SLICE:
            done.append(pa.array(waiting, kind))
            waiting, size = [], 0
    return pa.concat_arrays([*done, pa.array(waiting, kind)])


def dictionary_tokenizer(counts: DataFrame | dict[str, int], most: int = MOST_WORDS) -> Tokenizer:
    """A tokenizer with the words of a table (word, count), counts of a repeated word added up; ValueError if it has more than `most`."""
    if isinstance(counts, DataFrame):
        rows = counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("count").alias("count")).limit(most + 1).collect()
        counts = {r["word"]: int(r["count"]) for r in rows}
    if len(counts) > most:
        raise ValueError(f"a dictionary of more than {most} words")
    known = Dictionary(counts)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return cut_texts(texts, known.tokens)

    tokenizer: Callable = cut
    return tokenizer
