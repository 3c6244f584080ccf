"""What pages show: offset pages, counts, display forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import stored_level
from ..functions.text import shown, shown_nature, truncated
from ..schema import PAGE_SIZE

#: Places of a file that are counted together.
RANGE = 4096


def page_count(messages: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return messages.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size)))


def range_counts(messages: DataFrame) -> DataFrame:
    """(_file, _range, n): rows of each RANGE places of a file. Store it beside a table whose pages are asked for."""
    return messages.groupBy("_file", F.floor(F.col("_row") / RANGE).alias("_range")).agg(F.count("*").alias("n"))


def _within(counts: DataFrame, start: int, end: int) -> list[tuple[str, int, int]]:
    """(_file, _range, rows before) of the ranges with the rows from `start` up to `end`; at most one more than these rows.

    The files' counts choose the files, then the counts of these files choose the ranges.
    """
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (F.col("ahead") < end) & (F.col("ahead") + F.col("n") > start)
    files = counts.groupBy("_file").agg(F.sum("n").alias("n")).withColumn("ahead", ahead(Window.orderBy("_file"))).where(hit).select("_file", F.col("ahead").alias("of_file"))
    of_files = counts.join(F.broadcast(files), "_file").withColumn("ahead", F.col("of_file") + ahead(Window.partitionBy("_file").orderBy("_range"))).where(hit)
    return [(r["_file"], r["_range"], r["ahead"]) for r in of_files.collect()]


def page(messages: DataFrame, number: int, size: int = PAGE_SIZE, counts: DataFrame | None = None) -> DataFrame:
    """Page `number` in file and row order, clamped to the pages there are, with each row's place from 1.

    `counts` (of `range_counts`) tell which ranges of rows have the page, and only these are
    read: files and places are pushed down to the scan. Without it the rows are counted first.
    """
    counts = range_counts(messages) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    start = (max(1, min(number, -(-total // size) or 1)) - 1) * size
    chosen = _within(counts, start, start + size)
    if not chosen:
        return messages.limit(0).withColumn("place", F.lit(0).cast("long"))
    here = F.lit(False)
    for file, range_, _ in chosen:
        here = here | (F.col("_file") == file) & F.col("_row").between(range_ * RANGE, (range_ + 1) * RANGE - 1)
    before = F.coalesce(*(F.when((F.col("_file") == f) & (F.floor(F.col("_row") / RANGE) == r), F.lit(n)) for f, r, n in chosen))
    rows = messages.where(here).withColumn("_before", before)
    # Within a range: rows that went leave gaps in the places, so these are counted.
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_file", "_before").orderBy("_row"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place").between(start + 1, start + size)).drop("_before")


def display(messages: DataFrame) -> DataFrame:
    return messages.select("_file", "_row", truncated(F.col("content")).alias("summary"), shown(F.col("source"), "未填写来源").alias("source"), shown(F.col("publish_time"), "未填写时间").alias("publish_time"), shown_nature(F.col("nature")).alias("nature"), stored_level(F.col("fake_probability")).alias("level"))
