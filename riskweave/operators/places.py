"""Sets of rows as bits: which of each 64 rows of a file are in them.

Such a set is small beside texts or counted terms, so it goes to them and they stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a word of bits are 2 to the power of it; words that are broadcast at most, others are joined by a shuffle.
POWER, MOST_WORDS = 6, 1 << 18
_AT = f"int(pmod(_row, {1 << POWER}))"


def word() -> Column:
    return F.shiftright("_row", POWER).alias("_word")


def words(rows: DataFrame, *more: str) -> DataFrame:
    """(_file, more, _word, _bits) of the rows (_file, _row)."""
    return rows.groupBy("_file", *more, word()).agg(F.expr(f"bit_or(shiftleft(1L, {_AT}))").alias("_bits"))


def has() -> Column:
    """Whether `_bits` has the row."""
    return F.expr(f"getbit(_bits, {_AT}) = 1")


def before() -> Column:
    """How many rows of the word before this one `_bits` has."""
    return F.expr(f"bit_count(_bits & ~shiftleft(-1L, {_AT}))")


def few(words_: DataFrame) -> DataFrame:
    """Marked for a broadcast, if there are at most MOST_WORDS."""
    return F.broadcast(words_) if words_.limit(MOST_WORDS + 1).count() <= MOST_WORDS else words_


def _matched(rows: DataFrame, words_: DataFrame, how: str, more: Column | None) -> DataFrame:
    there = few(words_.withColumnsRenamed({"_file": "_file_of", "_word": "_word_of"}))
    same = (F.col("_file") == F.col("_file_of")) & (F.shiftright("_row", POWER) == F.col("_word_of")) & has()
    return rows.join(there, same if more is None else same & more, how)


def inside(rows: DataFrame, words_: DataFrame, more: Column | None = None) -> DataFrame:
    return _matched(rows, words_, "left_semi", more)


def outside(rows: DataFrame, words_: DataFrame, more: Column | None = None) -> DataFrame:
    return _matched(rows, words_, "left_anti", more)
