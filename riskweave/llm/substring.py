"""Repeated passages across documents: prefix-partitioned suffix trees over words.

A window is `width` consecutive words. A word goes if a window covers it whose word
sequence also starts in a document with a smaller doc_id.

1. Every document names its prefixes: of the word half-windows inside each window the
   one with the least hash, so equal windows name equal prefixes, at about one prefix in
   thirteen positions. Documents with equal word sequences count once; of those the later
   ones are repeats as a whole.
2. A prefix that only one document has holds no repeat across documents. For the others,
   the suffixes that begin in a window with this prefix go to the prefix's group.
3. Prefixes have variable length. A group whose suffixes fit in `group` bytes is read in
   one task: its suffixes are sorted, which lays out their suffix tree from left to right,
   and every internal node at a depth of `width` words or more, a run of sorted suffixes
   whose common prefixes stay that long, gives its smallest document. The prefixes of a
   larger group are lengthened to the full `width` words: each of those groups is one such
   node, and its smallest document comes from a partial aggregation, so no task holds a
   hot group.

Whole texts are shuffled only of documents that may have a shared prefix, or lose words: a
bit map of these, of bounded size, leaves most others where they are read.

Hashes only choose groups. What is removed is decided on the words themselves, or where
whole documents, hot windows and words of over 64 bytes are compared, on BLAKE2 digests.

Windows are judged on the input. Null and empty texts have no words; a text with fewer
than `width` words loses nothing. Rows with an equal doc_id are one document for "smaller":
each is cut by its own text and none by the others. Rows without doc_id come after all
others and are one such document. Repeated rows each get their result; an empty table gives
an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, grouped, new_folder, parted, slices, source, versioned
from .words import LONG, Words

#: Words of a window; bytes of a group's suffixes that a task may hold, each with so many besides its words.
WIDTH, GROUP, BESIDES = 50, 1 << 25, 128
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` consecutive hashes, by doubling."""
    out, have = hashes, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def prefixes(words: Words, width: int) -> list[np.ndarray]:
    """For each text the prefix hash that each of its windows names."""
    half = width // 2
    hashes, at = words.windows(half)
    span = width - half + 1
    return [_least(hashes[a:b], span) if b - a >= span else np.zeros(0, np.uint64) for a, b in zip(at, at[1:])]


def _named(batches, width: int):
    """Words, their digest, the prefixes of each text, and for each of these the bytes of its suffixes."""
    schema = pa.schema([("doc", pa.int64()), ("version", pa.binary()), ("n_words", pa.int64()), ("digest", pa.binary()), ("prefixes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
    for part in slices(batches, "text"):
        words = Words(part["text"])
        n = np.diff(words.offsets)
        ends = np.concatenate(([0], np.cumsum(np.minimum(words.ends - words.starts, LONG) + 1)))
        out: list[tuple] = []
        for i, named in enumerate(prefixes(words, width)):
            if not len(named):
                out.append((None, None, None))
                continue
            at = words.offsets[i] + np.arange(len(named))
            found, which = np.unique(named, return_inverse=True)
            out.append((blake2b(words.plain_text(i), digest_size=32).digest(), found.view(np.int64), np.bincount(which, ends[at + width] - ends[at] + BESIDES).astype(np.int64)))
        yield batch_of(schema, {"doc": part["doc"], "version": part["version"], "n_words": n, **dict(zip(("digest", "prefixes", "sizes"), map(list, zip(*out))))})


def _suffixes(batches, width: int):
    """A row for each run of windows that name one shared prefix of a small group, with its words as text.

    For large groups a document has one row: the digests of its windows, each once however
    often it recurs there, with its places.
    """
    window = pa.struct([("window", pa.binary()), ("places", pa.list_(pa.int32()))])
    schema = pa.schema([("prefix", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("passage", pa.binary()), ("windows", pa.list_(window))])
    for part in slices(batches, "text"):
        words = Words(part["text"])
        out: dict[str, list] = {f.name: [] for f in schema}
        for i, named in enumerate(prefixes(words, width)):
            if not len(named):
                continue
            small, large = (np.array(part[c][i].as_py() or [], np.int64).view(np.uint64) for c in ("small", "large"))
            shared = np.isin(named, small) | np.isin(named, large)
            if not shared.any():
                continue
            begins = np.concatenate(([0], np.flatnonzero(named[1:] != named[:-1]) + 1))
            ends, row, doc, base = np.concatenate((begins[1:], [len(named)])), part["row"][i].as_py(), part["doc"][i].as_py(), int(words.offsets[i])
            hot, deep = set(large.tolist()), {}
            rows = []
            for a, b in zip(begins[shared[begins]].tolist(), ends[shared[begins]].tolist()):
                pieces = words.pieces(base + a, base + b + width - 1)
                if int(named[a]) not in hot:
                    rows.append((int(named[a].astype(np.int64)), row, doc, a, b - a, b" ".join(pieces), None))
                    continue
                for j in range(b - a):
                    deep.setdefault(blake2b(b" ".join(pieces[j : j + width]), digest_size=16).digest(), []).append(a + j)
            if deep:
                rows.append((0, row, doc, 0, 0, None, [{"window": w, "places": at} for w, at in deep.items()]))
            for r in rows:
                for c, v in zip(schema.names, r):
                    out[c].append(v)
        if out["row"]:
            yield batch_of(schema, out)


def deep_nodes(passages: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """The suffix tree's nodes at depth `width`: for each the (passage, first word) of its suffixes.

    The suffixes, cut after `width` words, are sorted; neighbours that share all of
    them belong to one node.
    """
    suffixes = []
    for k, passage in enumerate(passages):
        at = [-1] + [i for i, c in enumerate(passage) if c == 32] + [len(passage)]
        suffixes += [(passage[at[j] + 1 : at[j + width]], k, j) for j in range(len(at) - width)]
    suffixes.sort()
    nodes, last = [], None
    for text, k, j in suffixes:
        if text != last:
            nodes.append([])
            last = text
        nodes[-1].append((k, j))
    return nodes


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _from_trees(batches, width: int):
    """Rows come sorted by prefix, row and first; one that comes again is skipped. Gives (row, first, last): runs of repeated windows."""
    schema = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    out: list[tuple[int, int, int]] = []

    def finish(rows):
        docs = [r[1] for r in rows]
        if len(set(docs)) < 2:
            return
        flags = [np.zeros(r[3], bool) for r in rows]
        for node in deep_nodes([r[4] for r in rows], width):
            least = min(docs[k] for k, _ in node)
            for k, j in node:
                if docs[k] > least:
                    flags[k][j] = True
        for r, f in zip(rows, flags):
            out.extend((r[0], r[2] + a, r[2] + b) for a, b in _runs(f))

    held, key = [], None
    for batch in batches:
        for prefix, *row in zip(*(batch[c].to_pylist() for c in ("prefix", "row", "doc", "first", "n", "passage"))):
            if prefix != key:
                finish(held)
                held, key = [], prefix
            if not held or held[-1][0] != row[0] or held[-1][2] != row[2]:
                held.append(row)
        if len(out) > 10_000:
            yield batch_of(schema, dict(zip(schema.names, zip(*out))))
            out.clear()
    finish(held)
    if out:
        yield batch_of(schema, dict(zip(schema.names, zip(*out))))


def _kept(batches, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
    for part in slices(batches, "text"):
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, text, whole, spans in zip(*(part[c].to_pylist() for c in ("doc_id", "text", "whole", "spans"))):
            words = _WORD.findall(text or "")
            n = len(words)
            if whole:
                words = []
            elif spans:
                gone = np.zeros(n + 1, np.int32)
                first, last = (np.array([s[k] for s in spans], np.int64) for k in ("first", "last"))
                np.add.at(gone, first, 1)
                np.add.at(gone, last + width - 1, -1)
                words = [w for w, g in zip(words, np.cumsum(gone)[:n].tolist()) if not g]
            for c, v in zip(schema.names, (doc, n, n - len(words), " ".join(words))):
                out[c].append(v)
        yield batch_of(schema, out)


def repeated_windows(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Per document (doc, version) that loses words: `whole`, or `spans`, the runs of its repeated windows (first, last)."""
    spark = docs.sparkSession
    named = docs.mapInArrow(lambda it: _named(it, width), "doc long, version binary, n_words long, digest binary, prefixes array<long>, sizes array<long>")
    named = cut(named.where("digest IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    firsts = cut(named.groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("first"), F.count("*").alias("n")))
    owned = grouped(named, firsts, "digest")
    entries = owned.where("row = first.row").select("row", "doc", F.explode(F.arrays_zip("prefixes", "sizes")).alias("p")).select("row", "doc", F.col("p.prefixes").alias("prefix"), F.col("p.sizes").alias("size"))
    shared = entries.groupBy("prefix").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("size")).where("lo < hi")
    found = grouped(entries.select("row", "prefix"), cut(shared.select("prefix", "n", (F.col("size") > group).alias("hot"))), "prefix")
    wanted = found.groupBy("row").agg(F.collect_list(F.when(~F.col("hot"), F.col("prefix"))).alias("small"), F.collect_list(F.when(F.col("hot"), F.col("prefix"))).alias("large"))
    wanted = cut(named.select("row", "doc", "version").join(wanted, "row"))
    rows = parted(docs, "doc", wanted)[0].join(wanted, ["doc", "version"]).select("row", "doc", "text", "small", "large").mapInArrow(lambda it: _suffixes(it, width), "prefix long, row long, doc long, first int, n int, passage binary, windows array<struct<window:binary,places:array<int>>>")
    folder = new_folder(spark, "suffixes")
    rows.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    trees = rows.where("passage IS NOT NULL").select("prefix", "row", "doc", "first", "n", "passage").repartition("prefix").sortWithinPartitions("prefix", "row", "first").mapInArrow(lambda it: _from_trees(it, width), "row long, first int, last int")
    leaves = rows.where("windows IS NOT NULL").select("row", "doc", F.inline("windows"))
    nodes = cut(leaves.groupBy("window").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi"))
    deep = grouped(leaves, nodes, "window").where("doc > lo").select("row", F.explode("places").alias("first")).withColumn("last", F.col("first") + 1)
    spans = trees.unionByName(deep).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    # Rows with the words of an earlier document go as a whole; those of the same doc_id lose what the first of them loses.
    whole = owned.where("doc > first.doc").select("doc", "version").distinct()
    same = owned.where("doc = first.doc").select("doc", "version", F.col("first.row").alias("row")).distinct().join(spans, "row").drop("row")
    return same.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("spans", F.lit(None).cast("array<struct<first:int,last:int>>")).withColumn("whole", F.lit(True)))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, group: int = GROUP, losing: bool = False) -> DataFrame:
    """Per row, or with `losing` per row that loses words: doc_id, n_words, n_removed and the text of the kept words, joined by one space."""
    docs = versioned(source(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")))
    losses = cut(repeated_windows(docs.drop("doc_id"), width, group))
    some, others = parted(docs, "doc", losses)
    rows = some.join(losses, ["doc", "version"], "inner" if losing else "left").select("doc_id", "text", "spans", "whole")
    if not losing:
        rows = rows.unionByName(others.select("doc_id", "text", *(F.lit(None).cast(losses.schema[c].dataType).alias(c) for c in ("spans", "whole"))))
    return rows.mapInArrow(lambda it: _kept(it, width), "doc_id long, n_words long, n_removed long, text string")
