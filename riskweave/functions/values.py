"""Column expressions that parse and normalise values; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NATURES, UNVERIFIED

_NUMBER = r"^[+-]?(?:(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*|\d+(?:_\d+)*\.?)(?:[eE][+-]?\d+(?:_\d+)*)?$"
_SPECIAL = r"(?i)^[+-]?(?:inf|infinity|nan)$"
TIME_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d")


def strip(value: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def number(value: Column) -> Column:
    """A double by the grammar of Python's float(): underscores between digits, signed nan and infinities; null if it isn't one."""
    text = strip(value)
    special = F.lower(F.regexp_replace(text, r"^\+", ""))
    return (
        F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))
        .when(text.rlike(_SPECIAL), F.when(special.isin("nan", "-nan"), F.lit(float("nan"))).when(special.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def two_decimals(value: Column) -> Column:
    """`%.2f` of a number from 0 to 100, rounding the exact binary value."""
    return F.regexp_replace(F.format_number(value, 2), ",", "")


def one_decimal(value: Column) -> Column:
    return F.regexp_replace(F.format_number(value, 1), ",", "")


def as_int(value: Column, default: int = 0) -> Column:
    """Truncate toward zero what parses as a finite number, else the default."""
    x = number(value)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 9.2e18)
    return F.when(finite, F.when(finite, x).cast("long")).otherwise(F.lit(default).cast("long"))


def probability(value: Column) -> Column:
    """Clamp to 0..100 with two decimals; "" stays "", what is no number is null (an error for the caller)."""
    text = strip(F.coalesce(value, F.lit("")))
    x = number(text)  # least and greatest skip nulls, so a null has to be kept out
    return F.when(text == "", F.lit("")).when(x.isNotNull(), two_decimals(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))))


def nature(value: Column) -> Column:
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(text.isin(*NATURES), text).otherwise(F.lit(UNVERIFIED))


def timestamp(value: Column) -> Column:
    """The first accepted format that reads the whole text; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)) for f in TIME_FORMATS))


def time(value: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS`; "" stays "", what no format reads is null."""
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(text == "", F.lit("")).otherwise(F.date_format(timestamp(text), "yyyy-MM-dd HH:mm:ss"))


def page_number(value: Column) -> Column:
    """A page argument: 1 if it is no integer or below 1."""
    return F.greatest(F.coalesce(strip(value.cast("string")).try_cast("int"), F.lit(1)), F.lit(1))


def csv_name(value: Column) -> Column:
    """Whether a table name is the bare name of a CSV file."""
    return F.lower(value).endswith(".csv") & ~value.rlike(r"[\\/]") & (value != "")


def now(fixed: str | None = None) -> Column:
    return F.lit(fixed) if fixed else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def normalized(field: str, value: Column) -> Column:
    """The normal form of one message field; null marks a value the form rejects."""
    kind = {"nature": nature, "fake_probability": probability, "publish_time": time, "process_time": time}
    return kind.get(field, lambda v: strip(F.coalesce(v, F.lit(""))))(value)
