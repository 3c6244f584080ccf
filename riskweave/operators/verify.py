"""The verification queue and conflict-checked edits.

Tables are immutable: every change is a function from messages and a batch of edits to
messages. An edit names its row by (_file, _row) and the signature it was made from; an
empty signature skips the check. A null field of an edit is left alone, "" empties it.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import signature, skip_key
from ..functions.values import normalized, now
from ..schema import COLUMNS, LABELLED, UNVERIFIED
from ..session import shared_folder
from . import places

KEY = ["_file", "_row"]


def unverified(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("nature") == UNVERIFIED).withColumn("key", skip_key(F.col("_file"), F.col("_signature")))


def live_skips(messages: DataFrame, skips: DataFrame) -> DataFrame:
    """Skip keys (key) that still name an unverified message."""
    return skips.select("key").distinct().join(unverified(messages).select("key"), "key", "left_semi")


def queue(messages: DataFrame, skips: DataFrame) -> DataFrame:
    """Unverified messages that aren't skipped; equal rows of a file share a key."""
    return unverified(messages).join(skips.select("key"), "key", "left_anti")


def next_message(messages: DataFrame, skips: DataFrame) -> DataFrame:
    return queue(messages, skips).orderBy(*KEY).limit(1)


def state(messages: DataFrame, skips: DataFrame) -> DataFrame:
    """One row (state, unverified, waiting): ready, all_skipped or all_verified."""
    open_ = unverified(messages).select("key").join(skips.select("key").distinct().withColumn("skipped", F.lit(True)), "key", "left")
    counts = open_.agg(F.count("*").alias("unverified"), F.count_if(F.col("skipped").isNull()).alias("waiting"))
    return counts.withColumn("state", F.when(F.col("unverified") == 0, "all_verified").when(F.col("waiting") > 0, "ready").otherwise("all_skipped"))


def add_skip(skips: Column, key: Column) -> Column:
    return F.array_union(skips, F.array(key))


def remove_skip(skips: Column, key: Column) -> Column:
    return F.array_remove(skips, key)


def statuses(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with status: ok, conflict (the row changed) or not_found."""
    current = messages.select(*KEY, F.col("_signature").alias("_now"))
    free = F.coalesce(F.col("signature"), F.lit("")) == ""
    status = F.when(F.col("_now").isNull(), "not_found").when(free | (F.col("signature") == F.col("_now")), "ok").otherwise("conflict")
    return edits.join(current, KEY, "left").withColumn("status", status).drop("_now")


def update(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply the edits that are ok. Of several of one row one applies: those with a signature come first, then the least in its values."""
    fields = [c for c in COLUMNS if c in edits.columns]
    free = F.coalesce(F.col("signature"), F.lit("")) == ""
    ok = statuses(messages, edits).where("status = 'ok'").select(*KEY, F.struct(free.alias("free"), *fields).alias("edit"))
    joined = messages.join(ok.groupBy(*KEY).agg(F.min("edit").alias("_edit")), KEY, "left")
    return joined.withColumns({c: F.coalesce(F.col("_edit")[c], F.col(c)) for c in fields}).drop("_edit").withColumn("_signature", signature())


def label(messages: DataFrame, edits: DataFrame, at: str | None = None) -> DataFrame:
    """Verify messages: edits (with nature) of the three labels set nature and process_time; others are ignored."""
    return update(messages, edits.where(F.col("nature").isin(*LABELLED)).withColumn("process_time", now(at)))


def delete(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Delete rows whose edit is ok; later rows of the file move up.

    How far a row moves is the number of deleted rows before it: those before its 64 rows,
    counted within ranges and over the ranges before, and those among the 64. So a file of
    any size is spread over many tasks, and messages stay where they are.
    """
    power = 16 - places.POWER
    gone = statuses(messages, edits).where("status = 'ok'").select(*KEY)
    words = messages.select("_file", places.word()).distinct().join(places.words(gone), ["_file", "_word"], "left")
    words = words.select("_file", "_word", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits"), F.shiftright("_word", power).alias("_range"))
    of_range = words.groupBy("_file", "_range").agg(F.sum(F.bit_count("_bits")).alias("n"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = of_range.select("_file", "_range", F.coalesce(F.sum("n").over(ahead(Window.partitionBy("_file").orderBy("_range"))), F.lit(0)).alias("_ahead"))
    within = F.coalesce(F.sum(F.bit_count("_bits")).over(ahead(Window.partitionBy("_file", "_range").orderBy("_word"))), F.lit(0))
    words = words.withColumn("_within", within).join(ranges, ["_file", "_range"]).select("_file", "_word", "_bits", (F.col("_ahead") + F.col("_within")).alias("_moved"))
    placed = messages.withColumn("_word", places.word()).join(places.few(words), ["_file", "_word"]).where(~places.has())
    return placed.withColumn("_row", F.col("_row") - F.col("_moved") - places.before()).select(*messages.columns)


def write_back(spark: SparkSession, path: str, edits: DataFrame) -> DataFrame:
    """Apply edits to the table that `write_messages` stored at `path`; the edits with their status, of which conflicts and missing rows were left out.

    Only files with an edit are read, and only those with one that applies are written: next
    to the table first, then moved to its place, so other files aren't touched. Signatures are
    compared with the rows as stored now. If a file was changed by another writer meanwhile,
    nothing is moved and an error is raised: run it again. The names of a batch's files go
    through the driver.
    """
    names = [r[0] for r in edits.select("_file").distinct().collect()]
    table = spark.read.parquet(path)
    messages = table.withColumn("_file", F.col("_file").cast("string")).where(F.col("_file").isin(names))
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def state(folder) -> list[tuple[str, int]]:
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    folders = {s.getPath().getName(): s.getPath() for s in fs.listStatus(Path(path)) if s.isDirectory() and unquote(s.getPath().getName().removeprefix("_file=")) in names}
    before = {name: state(folder) for name, folder in folders.items()}
    stage = f"{path.rstrip('/')}-stage-{uuid.uuid4().hex}"
    found = shared_folder(spark, "edits")
    statuses(messages, edits).write.parquet(found)
    done = spark.read.parquet(found)
    ok = done.where("status = 'ok'").drop("status")
    touched = messages.join(F.broadcast(ok.select("_file").distinct()), "_file", "left_semi")  # names of files
    update(touched, ok).select(*messages.columns).write.partitionBy("_file").parquet(stage)
    written = [s.getPath() for s in fs.listStatus(Path(stage)) if s.isDirectory()]
    if any(state(folder) != before[name] for name, folder in folders.items()):
        fs.delete(Path(stage), True)
        raise RuntimeError("the table was changed at the same time")
    for new in written:  # a rename for each file
        old, gone = Path(path, new.getName()), Path(stage, f".old-{new.getName()}")
        fs.rename(old, gone)
        fs.rename(new, old)
    fs.delete(Path(stage), True)
    spark.catalog.refreshByPath(path)
    return done


def append(messages: DataFrame, values: dict[str, str], file: str = "manual.csv", at: str | None = None) -> DataFrame:
    """Add one message: normal forms, nature unverified and publish_time now unless given."""
    spark = messages.sparkSession
    place = messages.where(F.col("_file") == file).agg(F.coalesce(F.max("_row") + 1, F.lit(0)).cast("long").alias("_row"))
    given = values | {c: v for c, v in {"nature": UNVERIFIED}.items() if not values.get(c)}
    row = place.select(*(normalized(c, F.lit(given.get(c) or "") if c != "publish_time" or given.get(c) else now(at)).alias(c) for c in COLUMNS), F.lit(file).alias("_file"), "_row").withColumn("_signature", signature())
    assert row.sparkSession is spark
    return messages.select(*row.columns).unionByName(row)
