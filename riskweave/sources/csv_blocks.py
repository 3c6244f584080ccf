"""One large quoted CSV file, read by many tasks.

A line end inside quotes ends no record, so where records begin hangs on all quotes before.
Blocks of the file's bytes are looked at on their own: for either state that a block's first
byte may be in, inside quotes or not, it reports the state behind its last byte, its first
record's begin, and how many records and rows begin in it. One walk over these reports, a row
for each block, tells every block's state and how many rows are before it. Then each block
parses the records that begin in it and reads on for the end of its last one.

A quote opens a quoted field at the begin of a field only and is a character elsewhere; a
doubled quote inside quotes is one. Empty lines are no rows; a record may be longer than a
block; short records have empty fields, long ones lose what is over; the last record needs no
line end. Lines end with LF, CR LF or CR.
"""

from __future__ import annotations

import csv
import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import COLUMNS, NA_TOKENS

#: Bytes of a block, bytes that are read at a time for the end of a block's last record, and rows of a batch.
BLOCK, MORE, ROWS = 32 << 20, 1 << 16, 8192
_QUOTE, _COMMA, _LF, _CR = b'",\n\r'
_BOM = b"\xef\xbb\xbf"
_BEFORE_FIELD = (_COMMA, _LF, _CR)


def opened(url: str):
    """A readable file of a path or URL, on any file system that Arrow knows."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:/"):
        system, path = fs.FileSystem.from_uri(url)
    else:
        system, path = fs.LocalFileSystem(), url
    return system.open_input_file(path)


def readable(url: str) -> bool:
    """Whether blocks of this file can be read at all."""
    try:
        with opened(url):
            return True
    except Exception:  # an unknown scheme, or one Arrow has no library for
        return False


def toggles(data: np.ndarray, before: int, quoted: bool) -> np.ndarray:
    """Places of the quotes that open or close a quoted field. `before` is the byte in front, -1 at the file's begin."""
    quotes = np.flatnonzero(data == _QUOTE)
    if not len(quotes):
        return quotes
    front = np.where(quotes > 0, data[quotes - 1].astype(np.int16), np.int16(before))
    if before < 0 and data[:3].tobytes() == _BOM:
        front[quotes == 3] = -1
    may_open = np.isin(front, (*_BEFORE_FIELD, -1))
    again = front == _QUOTE  # opens again after a quote that closed: a doubled one
    opening = np.arange(len(quotes)) % 2 == int(quoted)
    if not (opening & ~may_open & ~again).any():
        return quotes
    out, inside, closed = [], quoted, before == _QUOTE and not quoted
    for at, may, twice in zip(quotes.tolist(), may_open.tolist(), again.tolist()):
        if inside:
            inside, closed = False, True
            out.append(at)
        elif may or twice and closed:
            inside, closed = True, False
            out.append(at)
        else:
            closed = False
    return np.array(out, np.int64)


def record_begins(data: np.ndarray, before: int, quoted: bool) -> tuple[np.ndarray, bool]:
    """Places where a record begins, and the state behind the last byte."""
    turns = toggles(data, before, quoted)
    ends = np.flatnonzero((data == _LF) | (data == _CR)) + 1
    if before < 0 or before in (_LF, _CR):
        ends = np.concatenate(([0], ends))
    ends = ends[ends < len(data)]
    behind_cr = np.where(ends > 0, data[ends - 1] == _CR, before == _CR)
    ends = ends[~(behind_cr & (data[ends] == _LF))]
    inside = (np.searchsorted(turns, ends, "left") + quoted) % 2 == 1
    return ends[~inside], bool((len(turns) + quoted) % 2)


class Report(NamedTuple):
    #: For a block that begins outside and inside quotes: the state behind it, its first record's begin, how many records and rows begin in it.
    state: bool
    begin: int
    records: int
    rows: int


def report(data: np.ndarray, before: int, quoted: bool) -> Report:
    begins, state = record_begins(data, before, quoted)
    empty = np.isin(data[begins], (_LF, _CR)).sum() if len(begins) else 0
    return Report(state, int(begins[0]) if len(begins) else -1, len(begins), len(begins) - int(empty) - (before < 0 and len(data) > 0))


def _bytes(url: str, block: int, size: int) -> tuple[np.ndarray, int]:
    """A block and the byte in front of it."""
    start = block * size
    with opened(url) as f:
        f.seek(max(0, start - 1))
        data = np.frombuffer(f.read(size + (start > 0)), np.uint8)
    return (data[1:], int(data[0])) if start else (data, -1)


def _rest(url: str, at: int, quoted: bool) -> bytes:
    """The bytes from `at` on up to the end of the record that goes on there."""
    out = []
    with opened(url) as f:
        f.seek(at - 1)
        before = f.read(1)[0]
        while data := f.read(MORE):
            begins, state = record_begins(part := np.frombuffer(data, np.uint8), before, quoted)
            if len(begins):
                out.append(data[: int(begins[0])])
                break
            out.append(data)
            quoted, before = state, int(part[-1])
    return b"".join(out)


class File(NamedTuple):
    """A file to read in blocks: its name, URL, length, columns, and whether its lines end with CR LF, which then comes as LF inside quotes, too."""

    name: str
    url: str
    length: int
    columns: list[str]
    crlf: bool


def _reports(batches, files: list[File], size: int):
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), *((f"{n}{k}", pa.int64()) for k in (0, 1) for n in Report._fields)])
    for batch in batches:
        for file, block in zip(batch["file"].to_pylist(), batch["block"].to_pylist()):
            data, before = _bytes(files[file].url, block, size)
            values = [file, block, *(int(x) for quoted in (False, True) for x in report(data, before, quoted))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in values], schema=schema)


def _parsed(batches, files: list[File], size: int, columns: tuple[str, ...]):
    schema = pa.schema([*((c, pa.string()) for c in columns), ("_file", pa.string()), ("_row", pa.int64())])
    missing = frozenset(NA_TOKENS)
    csv.field_size_limit(1 << 62)  # fields are as long as they are
    for batch in batches:
        for number, block, begin, row, state in zip(*(batch[c].to_pylist() for c in ("file", "block", "begin", "row", "state"))):
            file = files[number]
            at = [file.columns.index(c) if c in file.columns else len(file.columns) for c in columns]
            data, _ = _bytes(file.url, block, size)
            raw = data[begin:].tobytes()
            if len(data) == size:
                raw += _rest(file.url, (block + 1) * size, bool(state))
            text = raw.decode("utf-8", "replace")
            if not block:
                text = text.removeprefix("\ufeff")
            reader = csv.reader(io.StringIO(text.replace("\r\n", "\n") if file.crlf else text, newline=""))
            if not block:
                next(reader, None)  # the header
            out: list[list] = [[] for _ in schema]
            for values in reader:
                if not values:
                    continue
                for k, place in enumerate(at):
                    value = values[place] if place < len(values) else ""
                    out[k].append("" if value in missing else value)
                out[-2].append(file.name)
                out[-1].append(row)
                row += 1
                if len(out[-1]) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
            if out[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)


def tasks(spark: SparkSession, blocks: int, size: int) -> int:
    """Tasks for so many blocks: small ones share a task of up to BLOCK bytes, as long as every core has one."""
    return max(1, min(blocks, max(spark.sparkContext.defaultParallelism, -(-blocks * size // BLOCK))))


def blocks_of(spark: SparkSession, files: list[File], size: int = BLOCK) -> list[tuple[int, int, int, int, int]]:
    """(file, block, begin, row, state) of the blocks in which records begin: where the first one begins, its row's number, and whether the block ends inside quotes."""
    blocks = [(k, b) for k, f in enumerate(files) for b in range(-(-f.length // size))]
    if not blocks:
        return []
    shape = "file long, block long, " + ", ".join(f"{f}{k} long" for k in (0, 1) for f in Report._fields)
    reports = spark.createDataFrame(blocks, "file long, block long").repartition(tasks(spark, len(blocks), size)).mapInArrow(lambda it: _reports(it, files, size), shape).collect()  # a row for each block
    out, file, quoted, row = [], None, 0, 0
    for r in sorted(reports):
        if r["file"] != file:
            file, quoted, row = r["file"], 0, 0
        mine = Report(*(r[f"{f}{quoted}"] for f in Report._fields))
        if mine.records:
            out.append((file, r["block"], mine.begin, row, int(mine.state)))
        row, quoted = row + mine.rows, int(mine.state)
    return out


def read_blocks(spark: SparkSession, files: list[File], columns: tuple[str, ...] = COLUMNS, size: int = BLOCK) -> DataFrame:
    """`columns` of the files as text, `_file` and `_row`. A task for each BLOCK bytes of blocks."""
    blocks = blocks_of(spark, files, size)
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in (*columns, "_file")), T.StructField("_row", T.LongType())])
    if not blocks:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(blocks, "file long, block long, begin long, row long, state long").repartition(tasks(spark, len(blocks), size))
    return rows.mapInArrow(lambda it: _parsed(it, files, size, columns), schema)
