"""The stored index: immutable segments of blocked postings, tombstones, versions.

A segment has `docs`, a row for each message with its signature, length and counted terms
(packed: the terms without a gap, and their numbers of bytes and counts as 32-bit integers),
and `blocks`: the postings of a term in BLOCK rows of a file, in row order, with their number,
their greatest count and their least length. Lengths stand in the postings, so scoring joins
nothing, and what a block can score at most is known without reading its postings. A term's
blocks lie in one of BUCKETS folders, so a search lists and reads those of its own terms only.

An update compares the rows (file, place, signature) of a message table with those of the
index. New and changed rows become one more segment; rows that are gone or changed become
tombstones, which hold for all older segments, together with what they take from term counts
and file statistics. So one changed row writes one row. Compaction makes blocks of
the counted terms of all rows that are alive, without reading a text again, and adds up the
counts; any order of updates and compactions leaves the same answers as an index written anew.

What is valid is what the latest file below `versions` lists. It appears in one step when
all its parts are written, so a failed or repeated run leaves parts nobody reads, which
`vacuum` removes. Two writers at a time: the second to finish gets an error and starts again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, words
from ..schema import INDEX_VERSION
from . import places
from .index import tokenized

#: Rows of a file whose postings of a term stand together; folders of a segment's blocks.
BLOCK, BUCKETS = 128, 16
_ROW = "array<struct<_row: long, tf: long, length: long>>"
SCHEMAS = {
    "docs": "_file string, _row long, _signature string, length long, terms binary, sizes binary, tfs binary",
    "blocks": f"term string, _file string, _block long, n long, max_tf long, min_length long, rows {_ROW}, bucket int",
    "gone": "_file string, _row long, _signature string",
    "fresh": "_file string, _row long, _signature string",
    "terms": "term string, df long",
    "stats": "_file string, doc_count long, total_length long",
}
KEY, PACKED = ["_file", "_row"], ["terms", "sizes", "tfs"]
FORMAT = INDEX_VERSION + 2
#: Files of an update whose names are pushed down to the scan of documents; more are joined only.
NAMED_FILES = 1000
#: Tokens whose postings are sorted in one task, so that it holds them in memory at any size of the input; tokens counted at a time.
TOKENS, COUNTED = 2_000_000, 1 << 18
#: Rows of blocks that leave a Python task together.
ROWS = 1 << 16


class Part(NamedTuple):
    #: Parts hold for older ones only; a part has segment tables, tombstone tables or both.
    number: int
    name: str
    added: int
    removed: int


class Changes(NamedTuple):
    added: int
    removed: int


class Index:
    """An index below `path`; one that was never written is empty."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer = words):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer

    # -------------------------------------------------------------- versions

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def version(self) -> int:
        """The number of the latest version, 0 if there is none."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def parts(self, version: int | None = None) -> list[Part]:
        version = self.version() if version is None else version
        if not version:
            return []
        fs, where = self._fs(f"{self.path}/versions/{version:010d}")
        stream = fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        state = json.loads(text)
        if state["format"] != FORMAT:
            raise ValueError(f"an index of format {state['format']}")
        return [Part(*p) for p in state["parts"]]

    def _commit(self, version: int, parts: list[Part]) -> None:
        fs, new = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(new)
        try:
            out.write(bytearray(json.dumps({"format": FORMAT, "parts": [list(p) for p in parts]}).encode()))
        finally:
            out.close()
        _, where = self._fs(f"{self.path}/versions/{version:010d}")
        if fs.exists(where) or not fs.rename(new, where):
            fs.delete(new, False)
            raise RuntimeError("the index was changed at the same time")

    def vacuum(self) -> None:
        """Remove parts and versions that the latest version doesn't need. No search of an older one may be running."""
        latest, needed = self.version(), {p.name for p in self.parts()}
        for folder, keep in (("parts", needed), ("versions", {f"{latest:010d}"})):
            for name in self._names(folder):
                if name not in keep:
                    fs, where = self._fs(f"{self.path}/{folder}/{name}")
                    fs.delete(where, True)

    # -------------------------------------------------------------- tables

    def _read(self, table: str, parts: list[Part] | None = None, where: Column | None = None) -> DataFrame:
        """A table of all parts, with the `_part` each row is from; with fixed columns, empty if no part has it."""
        of = {"docs": "added", "blocks": "added"}.get(table, "removed")
        out = None
        for p in self.parts() if parts is None else parts:
            if getattr(p, of) or table in ("stats", "terms") and p.added:
                rows = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/parts/{p.name}/{table}")
                rows = (rows if where is None else rows.where(where)).withColumn("_part", F.lit(p.number))
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], SCHEMAS[table] + ", _part int") if out is None else out

    def _alive(self, rows: DataFrame, parts: list[Part]) -> DataFrame:
        """Without rows that a younger part's tombstones name."""
        if not any(p.removed for p in parts):
            return rows
        gone = self._read("gone", parts).withColumnRenamed("_part", "_gone")
        return places.outside(rows, places.words(gone, "_gone"), F.col("_gone") > F.col("_part"))

    def docs(self) -> DataFrame:
        """(_file, _row, _signature, length) of the messages in the index."""
        parts = self.parts()
        return self._alive(self._read("docs", parts).select(*KEY, "_signature", "length", "_part"), parts).drop("_part")

    def stats(self) -> DataFrame:
        """(_file, doc_count, total_length)."""
        total = lambda c: F.sum(c).alias(c)
        return self._read("stats").groupBy("_file").agg(total("doc_count"), total("total_length")).where("doc_count > 0")

    def terms(self, where: Column | None = None) -> DataFrame:
        """(term, df) of all messages."""
        return self._read("terms", where=where).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """The blocks of all segments, or those of some terms: their folders and the terms themselves are pushed down to the scan."""
        if terms is None:
            return self._read("blocks")
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term")).select(bucket()).distinct().collect()] if terms else []
        return self._read("blocks", where=F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def postings(self, blocks: DataFrame) -> DataFrame:
        """(_part, term, _file, _block, _row, tf, length) of blocks, without rows that are gone."""
        rows = blocks.select("_part", "term", "_file", "_block", F.inline("rows"))
        return self._alive(rows, self.parts())

    # -------------------------------------------------------------- changes

    def _write(self, name: str, table: str, rows: DataFrame, *by: str) -> DataFrame:
        where = f"{self.path}/parts/{name}/{table}"
        rows.write.option("compression", "zstd").partitionBy(*by).parquet(where)
        return self.spark.read.schema(SCHEMAS[table]).parquet(where)

    def _write_segment(self, name: str, docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Write docs and their blocks; docs, (term, n) of each block, and the number of docs."""
        docs = self._write(name, "docs", docs)
        added, tokens = docs.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        blocks = self._write(name, "blocks", blocked(docs, tokens), "bucket") if added else self.spark.createDataFrame([], SCHEMAS["blocks"])
        return docs, blocks.select("term", "n"), added

    def _write_counts(self, name: str, terms: DataFrame, stats: DataFrame) -> None:
        """Write the sums of (term, df) and of (_file, doc_count, total_length)."""
        self._write(name, "terms", terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"))
        self._write(name, "stats", stats.groupBy("_file").agg(F.sum("doc_count").alias("doc_count"), F.sum("total_length").alias("total_length")))

    def update(self, messages: DataFrame, whole_files: bool = False) -> Changes:
        """Bring the index to the rows of `messages`; with `whole_files`, only the files that occur in it."""
        version, parts = self.version(), self.parts()
        name, number = uuid.uuid4().hex, max((p.number for p in parts), default=0) + 1
        rows = messages.select(*KEY, "_signature", "content")
        old = self._alive(self._read("docs", parts).select(*KEY, "_signature", "_part"), parts)
        if whole_files:
            old = old.join(rows.select("_file").distinct(), "_file", "left_semi")
        here, there = rows.select(*KEY, "_signature"), old.select(*KEY, "_signature")
        fresh, removed, counted = rows, 0, []
        if parts:  # keys are compared first; texts and terms stay where they are
            keys = self._write(name, "fresh", here.join(there, [*KEY, "_signature"], "left_anti"))
            fresh = places.inside(rows, places.words(keys))
            tombs = self._write(name, "gone", there.join(here, [*KEY, "_signature"], "left_anti"))
            removed = tombs.count()
            if removed:
                counted = self._without(tombs, removed, parts)
        docs, blocks, added = self._write_segment(name, documents(fresh, self.tokenizer))
        terms, stats = blocks.select("term", F.col("n").alias("df")), docs.select("_file", F.lit(1).alias("doc_count"), F.col("length").alias("total_length"))
        for t, n in counted:
            terms, stats = terms.unionByName(t), stats.unionByName(n)
        self._write_counts(name, terms, stats)
        if added or removed:
            self._commit(version + 1, [*parts, Part(number, name, added, removed)])
        return Changes(added, removed)

    def _without(self, tombs: DataFrame, removed: int, parts: list[Part]) -> list[tuple[DataFrame, DataFrame]]:
        """What rows that go take from (term, df) and (_file, doc_count, total_length): the counts of these rows or, if they are the most, all counts but those of rows that stay."""
        most = removed * 2 > sum(p.added - p.removed for p in parts)
        files = [] if most else [r[0] for r in tombs.select("_file").distinct().limit(NAMED_FILES + 1).collect()]
        known = self._read("docs", parts, F.col("_file").isin(files) if 0 < len(files) <= NAMED_FILES else None)
        known = self._alive(known.select(*KEY, "_part", "length", "terms", "sizes"), parts)
        rows, sign = (places.outside(known, places.words(tombs)), 1) if most else (places.inside(known, places.words(tombs)), -1)
        of_terms = rows.select("terms", "sizes").mapInArrow(_frequencies, "term string, df long")
        out = [(of_terms.select("term", (F.col("df") * sign).alias("df")), rows.select("_file", F.lit(sign).alias("doc_count"), (F.col("length") * sign).alias("total_length")))]
        if most:
            minus = lambda c: (-F.col(c)).alias(c)
            out.append((self._read("terms", parts).select("term", minus("df")), self._read("stats", parts).select("_file", minus("doc_count"), minus("total_length"))))
        return out

    def compact(self) -> None:
        """One segment of all that is alive; its counts are the sums of those of the parts."""
        version, parts = self.version(), self.parts()
        if len(parts) < 2:
            return
        name, number = uuid.uuid4().hex, max(p.number for p in parts) + 1
        *_, added = self._write_segment(name, self._alive(self._read("docs", parts), parts).drop("_part"))
        self._write_counts(name, self._read("terms", parts), self._read("stats", parts))
        self._commit(version + 1, [Part(number, name, added, 0)] if added else [])


def bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def documents(messages: DataFrame, tokenizer: Tokenizer = words) -> DataFrame:
    """(_file, _row, _signature, length, terms, sizes, tfs) of messages; one pass over the texts, no shuffle."""
    most = COUNTED
    return tokenized(messages, (*KEY, "_signature"), tokenizer).mapInArrow(lambda it: _counted(it, most), SCHEMAS["docs"])


def _ranked(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each string among the distinct ones in their order, and these."""
    coded = strings.dictionary_encode("encode")
    order = pc.sort_indices(coded.dictionary)
    ranks = np.empty(len(order), np.int64)
    ranks[order.to_numpy()] = np.arange(len(order))
    return ranks[coded.indices.to_numpy()], coded.dictionary.take(order)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)


def _counted(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The tokens of each row as its distinct terms in order, with their counts; about `most` tokens at a time."""
    for batch in batches:
        slices = np.cumsum(_sizes(batch["tokens"])) // most
        cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            rows = batch.slice(a, b - a)
            sizes = _sizes(rows["tokens"])
            ranks, terms = _ranked(rows["tokens"].flatten())
            n = max(1, len(terms))
            runs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + ranks, return_counts=True)
            ends = np.cumsum(np.bincount(runs // n, minlength=len(sizes)))
            of_rows = _packed(terms.take(pa.array(runs % n)), counts, ends)
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in (*KEY, "_signature")), pc.list_value_length(rows["tokens"]).cast(pa.int64()), *of_rows], names=[*KEY, "_signature", "length", *PACKED])


def _binaries(data: pa.Buffer, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Strings or binaries that end there in the data."""
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), data])


def _data(binaries: pa.Array) -> pa.Buffer:
    """The bytes of all strings or binaries."""
    binaries = binaries.cast(pa.binary())
    if not len(binaries):
        return pa.py_buffer(b"")
    at = np.frombuffer(binaries.buffers()[1], np.int32)[binaries.offset : binaries.offset + len(binaries) + 1]
    return binaries.buffers()[2][int(at[0]) : int(at[-1])] if at[-1] > at[0] else pa.py_buffer(b"")


def _packed(terms: pa.Array, counts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Columns terms, sizes and tfs of rows whose terms end there."""
    sizes = pc.binary_length(terms).fill_null(0).to_numpy().astype(np.int32)
    bytes_ = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[ends]
    return [_binaries(_data(terms), bytes_, pa.binary()), *(_binaries(pa.py_buffer(x.astype(np.int32)), ends * 4, pa.binary()) for x in (sizes, counts))]


def _terms(rows: pa.RecordBatch) -> pa.Array:
    """The terms of all rows, one after the other."""
    return _binaries(_data(rows["terms"]), np.cumsum(np.frombuffer(_data(rows["sizes"]), np.int32), dtype=np.int64), pa.string())


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a batch have each term."""
    for batch in batches:
        coded = _terms(batch).dictionary_encode()
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), pa.int64())], names=["term", "df"])


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def _folded(batches: Iterable[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with packed terms that come in the order of file and row, in the order of term, file and row for about `most` postings at a time; the last block of a batch may go on in the next."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(_data(batch["tfs"])) // 4
        if n >= most:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(_blocks_of(rows, size)[-1])
            if last:
                yield from _block_rows(rows.slice(0, last), size)
            held = [rows.slice(last)]
            n = len(_data(held[0]["tfs"])) // 4
    rows = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    if rows:
        yield from _block_rows(rows[0], size)


def _blocks_of(rows: pa.RecordBatch, size: int) -> np.ndarray:
    """The first row of each block."""
    return _begins(rows["_file"].dictionary_encode().indices.to_numpy(), rows["_row"].to_numpy() // size)


def _block_rows(rows: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A row for each term of each block."""
    firsts, counts = _blocks_of(rows, size), pc.binary_length(rows["tfs"]).to_numpy().astype(np.int64) // 4
    ranks, terms = _ranked(_terms(rows))
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(ranks * len(counts) + of)  # no two are equal
    ranks, of, tf = ranks[order], of[order], np.frombuffer(_data(rows["tfs"]), np.int32)[order]
    block = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(counts))))[of]
    row, length = rows["_row"].to_numpy()[of], rows["length"].to_numpy()[of]
    at = _begins(ranks, block)
    ends, first = np.append(at, len(order)), firsts[block[at]]
    of_block = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (row, tf, length)], ["_row", "tf", "length"]))
    numbers = row[at] // size, np.diff(ends), np.maximum.reduceat(tf, at), np.minimum.reduceat(length, at)
    columns = [terms.take(pa.array(ranks[at])), rows["_file"].take(pa.array(first)), *(pa.array(x, pa.int64()) for x in numbers), of_block]
    blocks = pa.RecordBatch.from_arrays(columns, names=["term", "_file", "_block", "n", "max_tf", "min_length", "rows"])
    for k in range(0, blocks.num_rows, ROWS):
        yield blocks.slice(k, ROWS)


def blocked(docs: DataFrame, tokens: int) -> DataFrame:
    """Blocks of the counted terms of documents with `tokens` tokens in all. Whole rows are shuffled, so that a task has all rows of its blocks and sorts their postings itself."""
    size, most = BLOCK, TOKENS
    rows = docs.where(F.octet_length("tfs") > 0).select(*KEY, "length", *PACKED).repartition(max(1, -(-tokens // most)), "_file", F.floor(F.col("_row") / size))
    blocks = rows.sortWithinPartitions(*KEY).mapInArrow(lambda it: _folded(it, size, most), SCHEMAS["blocks"].removesuffix(", bucket int"))
    return blocks.withColumn("bucket", bucket())
