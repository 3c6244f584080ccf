"""Column expressions of the risk rules: bands, output validation, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVEL_LABELS
from .values import number


def level(score: Column) -> Column:
    return F.when(score < 40, "low").when(score < 70, "medium").when(score.isNotNull(), "high")


def label(level_: Column) -> Column:
    return F.coalesce(*(F.when(level_ == k, F.lit(v)) for k, v in LEVEL_LABELS.items()))


def valid_score(score: Column) -> Column:
    """A finite score from 0 to 100, else null."""
    return F.when(~F.isnan(score) & score.between(0, 100), score)


def stored_level(value: Column) -> Column:
    """Band of a stored probability; what is no number counts as 0."""
    x = F.coalesce(number(value), F.lit(0.0))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("待检测")).when(F.isnan(x), F.lit("low")).otherwise(level(x))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
