"""Helpers the corpus operators share: lineage cuts, shared folders, ranks, joins with hot groups or few keys, Arrow slices."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time; a longer text comes alone.
SLICE_BYTES = 1 << 20
#: A group is hot that has more than one row in so many; so there are fewer hot groups than that.
HEAVY = 4096
#: Bits of the map of keys that `parted` broadcasts, at most: a million rows of 64.
MOST_BITS = 1 << 26
#: Stands for a missing doc_id, after all others.
LAST = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one, which only a local master may use and which goes at exit."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="riskweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation of Python stages."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder below the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """`df` written as Parquet to a new folder and read from there, and the folder: a lineage cut that can be removed again. `codec` is another compression than the session's."""
    folder = new_folder(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, *folders: str) -> None:
    """Remove folders that no later step reads."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(url: str):
    """The Arrow file system of a URL or path, and the path on it."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:/"):
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), os.path.abspath(url)


def source(df: DataFrame, **columns: str) -> DataFrame:
    """The columns an operator reads, by its own names; others, clashing names included, stay out of the plan."""
    return df.select(*(df[col].alias(name) for name, col in columns.items()))


def width(df: DataFrame) -> int:
    """Tasks for a shuffle of whole texts: as many as the scan has, and not under the session's shuffle partitions."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salts(rows: int) -> int:
    """Salts for groups that may hold a third of `rows`: small groups at first, at most about a million rows later."""
    return max(1, min(rows // 500, 4096), rows // 1_000_000)


def ranked(df: DataFrame, group: str, order: list[Column], salt: Column, n_salts: int, name: str = "rank") -> DataFrame:
    """Add the rank from 0 of each row within `group`, without gathering a group in one task.

    Rows are numbered within (group, salt); the counts of the salts, a small table,
    give each salt its offset. `df` has to be deterministic (cut before).
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(n_salts)).cast("int"))
    ahead = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n")).select(group, "_salt", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))
    return salted.withColumn("_within", within).join(offsets, [group, "_salt"]).withColumn(name, F.col("_ahead") + F.col("_within") - 1).drop("_salt", "_within", "_ahead")


def versioned(docs: DataFrame) -> DataFrame:
    """Add `doc`, the doc_id as a number with missing ones last, and `version`, a digest of the text: what tells documents apart."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("version", digest)


def grouped(df: DataFrame, groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Join `groups` (key, n, ...) to the rows of `df`, of which a group has `n`.

    Hot groups, fewer than HEAVY by their definition, are broadcast, so that no task gets
    all rows of one; the others are shuffled. `groups` should be cut before.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(n) * HEAVY > total))
    rest = groups.where(F.col(n) * HEAVY <= total)
    return df.join(hot, key).unionByName(df.join(hot.select(key), key, "left_anti").join(rest, key))


def parted(df: DataFrame, key: str, keys: DataFrame, most: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` whose `key` may be among those of `keys`, and all others, none of which is; no row of `df` is shuffled.

    A bit map of the keys' hashes, of at most `most` bits, is broadcast. Few other rows come
    with the first, more once the map fills up: join these with `keys`. `keys` should be cut before.
    """
    size = min(most, 1 << max(16, (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(size))
    word, bits = (f"_{name}_{uuid.uuid4().hex}" for name in ("word", "bits"))
    place = (at % 64).cast("int")
    table = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias(bits))
    marked = df.join(F.broadcast(table), F.floor(at / 64) == F.col(word), "left")
    on = F.coalesce(F.getbit(F.col(bits), place) == 1, F.lit(False))
    return marked.where(on).drop(word, bits), marked.where(~on).drop(word, bits)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that `column` has at most `most` bytes in a slice, or one row."""
    for batch in batches:
        text = batch.column(column)
        if not len(text):
            continue
        sizes = pc.binary_length(text).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch of Python lists, numpy arrays or Arrow arrays."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)
