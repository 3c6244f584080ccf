"""Batch scoring of a message table into fake_probability, in one go or in slices that a stopped run takes up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import valid_score
from ..functions.values import two_decimals
from ..schema import CHECKPOINT_EVERY


def pending(override: bool) -> Column:
    """Rows to score: all, or those whose stored text is empty."""
    return F.lit(True) if override else F.coalesce(F.col("fake_probability") == "", F.lit(True))


def scored(messages: DataFrame, score: Column, override: bool = False) -> DataFrame:
    """Write valid scores back; add outcome: done, failed or skipped. A failed row keeps what it had."""
    valid = valid_score(score)
    outcome = F.when(~pending(override), "skipped").when(valid.isNotNull(), "done").otherwise("failed")
    return messages.withColumn("outcome", outcome).withColumn("fake_probability", F.when(F.col("outcome") == "done", two_decimals(valid)).otherwise(F.col("fake_probability")))


def counts(scored_: DataFrame) -> DataFrame:
    return scored_.groupBy("_file").agg(F.count_if(F.col("outcome") == "done").alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def checkpoints(scored_: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """(_file, _row, done): the rows after which a file is saved, each `every` successes in row order.

    The running count is taken within ranges of rows; the ranges' counts, a small table, are
    added in front, so a file of any size is spread over many tasks.
    """
    size = 65_536
    ok = scored_.where("outcome = 'done'").select("_file", "_row", F.floor(F.col("_row") / size).alias("_range"))
    ahead = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ok.groupBy("_file", "_range").agg(F.count("*").alias("n")).select("_file", "_range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    running = ok.withColumn("_within", F.row_number().over(Window.partitionBy("_file", "_range").orderBy("_row"))).join(before, ["_file", "_range"])
    return running.select("_file", "_row", (F.col("_ahead") + F.col("_within")).alias("done")).where(F.col("done") % every == 0)


# ------------------------------------------------------------------ runs that can be stopped

_ENTRY = "_file string, _row long, _signature string, score double, run int"
_KEY = ["_file", "_row", "_signature"]
#: Rows of each file in a slice.
SLICE = 100_000


class Journal:
    """What runs have scored so far: (_file, _row, _signature, score, run), appended to by every finished slice.

    An entry stands for itself: of a slice whose job was lost while it was written, the
    entries that are there count. `score` is null where the model failed.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(self.path)

    def runs(self) -> int:
        """The number of the latest run, 0 before the first one."""
        return self.entries().agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]

    def append(self, scored_: DataFrame, run: int) -> None:
        scored_.select(*_KEY, F.col("score").cast("double").alias("score"), F.lit(run).alias("run")).write.mode("append").parquet(self.path)


def run_slices(messages: DataFrame, score: Callable[[DataFrame], DataFrame], journal: Journal, override: bool = False, size: int = SLICE, run: int = 1) -> int:
    """Score what `journal` doesn't have from this run, slice by slice; the number of slices that had rows.

    `score` adds a column score to messages. A slice is `size` rows of every file; its
    scores are in the journal before the next one begins. A run that was stopped goes on under
    the same number: rows with an entry, whether scored or failed, aren't scored again, and
    rows that changed since are. A row repeats in no slice, so none is scored twice.
    """
    wanted = messages.where(pending(override))
    if "_signature" not in messages.columns:
        raise ValueError("messages need signatures")
    last, done = wanted.agg(F.max("_row")).first()[0], 0
    for k in range(0 if last is None else last // size + 1):
        known = journal.entries().where((F.col("run") == run) & F.col("_row").between(k * size, (k + 1) * size - 1))
        rows = wanted.where(F.col("_row").between(k * size, (k + 1) * size - 1)).join(known.select(*_KEY), _KEY, "left_anti")
        if not rows.isEmpty():
            journal.append(score(rows), run)
            done += 1
    return done


def resumed(messages: DataFrame, journal: Journal, override: bool = False) -> DataFrame:
    """As `scored`, from the journal: of a row's valid scores the one of the last run is written back; a row that only failed keeps what it had."""
    entry = journal.entries().withColumn("valid", valid_score(F.col("score")))
    best = entry.groupBy(*_KEY).agg(F.max_by("valid", F.when(F.col("valid").isNotNull(), F.struct("run", "valid"))).alias("_valid"))
    joined = messages.join(best.withColumn("_known", F.lit(True)), _KEY, "left")
    outcome = F.when(~pending(override), "skipped").when(F.col("_valid").isNotNull(), "done").when(F.col("_known"), "failed").otherwise("pending")
    written = F.when(F.col("outcome") == "done", two_decimals(F.col("_valid"))).otherwise(F.col("fake_probability"))
    return joined.withColumn("outcome", outcome).withColumn("fake_probability", written).select(*messages.columns, "outcome")
