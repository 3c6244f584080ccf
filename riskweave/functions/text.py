"""Column expressions over message texts: tokens, signatures, display forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COLUMNS, UNVERIFIED

Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; the default tokenizer."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def han_bigrams(text: Column) -> Column:
    """As `words`, but a run of Han characters gives its overlapping pairs (a single one itself)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2,}$"), pairs(r)).otherwise(F.array(r))))


def segmenter(name: str = "words") -> Tokenizer:
    """A tokenizer by name; `jieba` needs that package on the executors."""
    if name != "jieba":
        return {"words": words, "han_bigrams": han_bigrams}[name]
    import pandas as pd

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        import jieba

        tokens = lambda t: [w for w in (x.strip().lower() for x in jieba.cut_for_search(t or "")) if any(c.isalnum() for c in w)]
        return texts.map(tokens)

    return cut


def tagger() -> Callable[[Column], Column]:
    """The part of speech of a term's first segment, "" if there is none; needs jieba on the executors."""
    import pandas as pd

    @F.pandas_udf("string")
    def tag(terms: pd.Series) -> pd.Series:
        import jieba.posseg

        return terms.map(lambda t: next((flag for _, flag in jieba.posseg.cut(t or "")), ""))

    return tag


def signature(columns: tuple[str, ...] = COLUMNS) -> Column:
    """The first 16 hexadecimal digits of SHA-1 over the columns joined by U+001F; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in columns)).cast("binary")), 1, 16)


def truncated(text: Column, length: int = 140, leeway: int = 5) -> Column:
    """Cut at a word boundary with an ellipsis, unless the text is at most `leeway` too long."""
    return F.when(F.length(text) <= length + leeway, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, length - 3), " [^ ]*$", ""), F.lit("...")))


def shown(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def shown_nature(value: Column) -> Column:
    return shown(value, UNVERIFIED)


def skip_key(file: Column, signature_: Column) -> Column:
    return F.concat_ws(":", file, signature_)
