"""The message table: a folder of CSV files with one logical schema.

Files match by column name, whatever their order; a missing column is empty, others are
dropped. A row's place in its file is `_row`, its content signature is `_signature`.
"""

from __future__ import annotations

import csv
import io
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import signature
from ..schema import COLUMNS, NA_TOKENS
from .csv_blocks import BLOCK, File, read_blocks, readable

#: Bytes from which a file is read in blocks.
LARGE = 8 * BLOCK
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the CSV files directly in `folder`, sorted; none if there is no such folder."""
    fs, where, _ = _hadoop(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isFile() and s.getPath().getName().endswith(".csv"))


def checked_name(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a table; ValueError for a name that is no bare CSV name, FileNotFoundError if it doesn't exist."""
    if not name or not name.lower().endswith(".csv") or any(c in name for c in "/\\"):
        raise ValueError(f"not a table name: {name!r}")
    fs, _, Path = _hadoop(spark, folder)
    if not fs.exists(Path(folder, name)):
        raise FileNotFoundError(name)
    return f"{folder.rstrip('/')}/{name}"


def _literal(path: str) -> str:
    """A path whose characters that mean something in a glob stand for themselves."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def _header(spark: SparkSession, fs, path) -> list[str] | None:
    """The column names in a file's first record; none for an empty file."""
    java = spark.sparkContext._jvm.java
    reader = java.io.BufferedReader(java.io.InputStreamReader(fs.open(path), java.nio.charset.StandardCharsets.UTF_8))
    try:
        line = reader.readLine()
        while line is not None and line.count('"') % 2 and (more := reader.readLine()) is not None:
            line += "\n" + more
    finally:
        reader.close()
    return None if line is None else next(csv.reader(io.StringIO(line.removeprefix("\ufeff"))), [])


def _ends_with_crlf(spark: SparkSession, fs, path) -> bool:
    """Whether the first line of a file does."""
    stream = fs.open(path)
    try:
        while (byte := stream.read()) not in (-1, 10, 13):
            pass
        return byte == 13 and stream.read() == 10
    finally:
        stream.close()


def _read(spark: SparkSession, paths: list[str], names: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Files with one header, in one scan: `columns` as text and _file; a file comes in one piece."""
    places = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(names))])
    raw = spark.read.schema(places).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv([_literal(p) for p in paths])
    missing = F.lit("")
    clean = lambda c: F.when(F.col(c).isNull() | F.col(c).isin(*NA_TOKENS), missing).otherwise(F.col(c))
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # Spark gives names as in URLs
    return raw.select(*((clean(f"_{names.index(c)}") if c in names else missing).alias(c) for c in columns), name.alias("_file"))


def _scans(spark: SparkSession, paths: list[str], columns: tuple[str, ...]) -> DataFrame:
    """One scan for each distinct header, however many files have it."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        fs, where, _ = _hadoop(spark, path)
        if fs.exists(where) and (names := _header(spark, fs, where)):
            groups.setdefault(tuple(names), []).append(path)
    out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_file")]))
    for names, files in groups.items():
        out = out.unionByName(_read(spark, files, list(names), columns))
    return out


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One file, all columns as text; missing file or zero bytes give an empty table."""
    return _scans(spark, [path], columns).select(*columns)


def _counted(batches):
    """Add the row's place in its file; a file comes in one piece and in order."""
    file, row = None, 0
    for batch in batches:
        rows = []
        for name in batch["_file"].to_pylist():
            file, row = (name, row + 1) if name == file else (name, 0)
            rows.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], names=[*batch.schema.names, "_row"])


def located(table: DataFrame) -> DataFrame:
    """Add `_row` (0-based, in file order) and `_signature` to a scan with `_file`. Needs no shuffle."""
    schema = T.StructType([*table.schema.fields, T.StructField("_row", T.LongType())])
    return table.mapInArrow(_counted, schema).withColumn("_signature", signature())


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return located(_scans(spark, [checked_name(spark, folder, name)], COLUMNS))


def load_all(spark: SparkSession, folder: str, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """All tables of a folder; (_file, _row) gives their order. Files of at least `large` bytes are read in blocks, by many tasks each."""
    fs, where, Path = _hadoop(spark, folder)
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in list_tables(spark, folder)}
    in_blocks = {name for name, path in paths.items() if fs.getFileStatus(Path(path)).getLen() >= large and readable(path)}
    found = []
    for name in sorted(in_blocks):
        path = Path(paths[name])
        if names := _header(spark, fs, path):
            found.append(File(name, paths[name], fs.getFileStatus(path).getLen(), names, _ends_with_crlf(spark, fs, path)))
    out = located(_scans(spark, [p for name, p in paths.items() if name not in in_blocks], COLUMNS))
    return out.unionByName(read_blocks(spark, found, COLUMNS, block).withColumn("_signature", signature())) if found else out


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(_file, _row, content, nature) of the tables that have both columns; others are skipped."""
    paths = [f"{folder.rstrip('/')}/{name}" for name in list_tables(spark, folder)]
    usable = [p for p in paths if {"content", "nature"} <= set(_header(spark, *_hadoop(spark, p)[:2]) or ())]
    return located(_scans(spark, usable, COLUMNS)).select("_file", "_row", "content", "nature")


def _csv(table: DataFrame, folder: str, *by: str) -> None:
    table.write.partitionBy(*by).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def move_part(spark: SparkSession, stage: str, folder: str, name: str) -> None:
    """Rename the one part of a written folder over folder/name in one step, so that readers see the old file or the new one; then remove the folder."""
    fs, where, Path = _hadoop(spark, stage)
    part = next(s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = fs.makeQualified(Path(folder, name))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), target, over)
    fs.delete(where, True)


def write_table(table: DataFrame, folder: str, name: str) -> None:
    """Replace a table as one CSV file of the six columns.

    Rows keep the order of `_row` if the table has it. A message file is one file by
    definition and comes from one task; large collections belong in `write_messages`.
    """
    stage = f"{folder.rstrip('/')}/.stage-{uuid.uuid4().hex}"
    if "_row" in table.columns:
        table = table.orderBy("_row")
    _csv(table.select(*COLUMNS).coalesce(1), stage)
    move_part(table.sparkSession, stage, folder, name)


def write_tables(messages: DataFrame, folder: str) -> None:
    """Replace the CSV files of every `_file` in `messages`, written by one job, one task for each file; rows keep the order of `_row`."""
    spark, stage = messages.sparkSession, f"{folder.rstrip('/')}/.stage-{uuid.uuid4().hex}"
    rows = messages.select("_row", *COLUMNS, F.col("_file").alias("_to")).repartition("_to").sortWithinPartitions("_to", "_row").drop("_row")
    _csv(rows, stage, "_to")
    fs, where, _ = _hadoop(spark, stage)
    for status in fs.listStatus(where):  # a rename for each file
        if status.isDirectory():
            move_part(spark, status.getPath().toString(), folder, unquote(status.getPath().getName().removeprefix("_to=")))
    fs.delete(where, True)


def write_messages(messages: DataFrame, path: str) -> None:
    """Write the logical table as Parquet, one folder for each `_file`; only the folders of files in `messages` are replaced."""
    messages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_file").parquet(path)


def ensure_folder(spark: SparkSession, folder: str, manual: str = "manual.csv") -> None:
    """Make the folder and an empty table for messages added by hand."""
    fs, where, Path = _hadoop(spark, folder)
    fs.mkdirs(where)
    if not fs.exists(Path(folder, manual)):
        write_table(spark.createDataFrame([], SCHEMA), folder, manual)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Stop words (term): lines in lower case without blanks and # comments; none if there is no such file."""
    fs, where, _ = _hadoop(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], "term string")
    term = F.lower(F.trim("value"))
    return spark.read.text(path).select(term.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()
