"""Token ids in binary files: bit-plane shuffled blocks, zstandard, chunk index.

A file holds the ids of consecutive documents. Ids come in blocks of fixed size; a block
is transposed into 32 bit planes of the 32-bit ids (or 4 byte planes), each plane is
compressed alone, and planes of zeros take no bytes. After the blocks comes the index: for
each block its place, ids and plane sizes, and for each document its id and length, so a
reader gets any document by reading the blocks that hold it.

    "RWT1" | blocks | zstd(index) | index size (8 bytes) | "RWT1"

Files are written by the tasks of a range partitioning by doc_id to names of their own;
only the manifest, which has the files of successful tasks, says which ones count, so a
repeated task leaves nothing wrong behind.

Null and empty texts have the end id only; a null doc_id sorts first; rows with the same
doc_id follow one another; texts are encoded whole, however long, and one longer than a block
is in several; other columns, clashing names included, are not read; an empty table gives no
file and no rows.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_encoder
from .common import batch_of, cut, filesystem, slices, source, width

MAGIC, BLOCK = b"RWT1", 1 << 17
MANIFEST = "path string, first_doc long, docs long, ids long, bytes long"


def planes_of(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Transpose 32-bit ids into planes; a plane of zeros is empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = raw.T if kind == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    return [p.tobytes() if p.any() else b"" for p in planes]


def ids_of(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids whose planes these are."""
    if kind == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((32, n), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[k] = np.unpackbits(np.frombuffer(p, np.uint8))[:n]
        raw = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class TokenWriter:
    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.kind, self.block = out, kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.index: dict[str, list] = {"blocks": [], "docs": []}
        self.ids = 0
        out.write(MAGIC)

    def add(self, doc, ids: np.ndarray) -> None:
        self.index["docs"].append([doc, len(ids)])
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            for i in range(0, len(ids) - self.block + 1, self.block):
                self._flush(ids[i : i + self.block])
            self.held = [ids[len(ids) - len(ids) % self.block :]]
            self.n_held = len(self.held[0])

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) if p else b"" for p in planes_of(ids, self.kind)]
        self.out.write(b"".join(planes))
        self.index["blocks"].append([self.at, len(ids), [len(p) for p in planes]])
        self.at += sum(map(len, planes))

    def close(self) -> int:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        index = self.zstd.compress(json.dumps(self.index | {"kind": self.kind}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        return self.at + len(index) + 8 + len(MAGIC)


def read_tokens(file, size: int):
    """Yield (doc_id, ids) of a random-access file, block by block."""
    tail = file.read_at(12, size - 12)
    if tail[8:] != MAGIC or file.read_at(4, 0) != MAGIC:
        raise ValueError("not a token file")
    n = int.from_bytes(tail[:8], "little")
    unzip = zstandard.ZstdDecompressor()
    index = json.loads(unzip.decompress(file.read_at(n, size - 12 - n)))
    blocks, held, have = iter(index["blocks"]), [], 0
    for doc, length in index["docs"]:
        while have < length:
            at, ids, sizes = next(blocks)
            raw, cuts = file.read_at(sum(sizes), at), np.concatenate(([0], np.cumsum(sizes)))
            planes = [unzip.decompress(raw[a:b]) if b > a else b"" for a, b in zip(cuts, cuts[1:])]
            held.append(ids_of(planes, ids, index["kind"]))
            have += ids
        ids = held[0] if len(held) == 1 else np.concatenate(held)
        yield doc, ids[:length]
        held, have = [ids[length:]], have - length


def _write(batches, path: str, folder: str, end_id: int, kind: str):
    schema = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
    encode, end = byte_encoder(path), np.array([end_id], np.uint32)
    writer, name = None, f"{folder}/part-{uuid.uuid4().hex}.tok"
    for part in slices(batches, "text"):
        for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
            if writer is None:
                fs, where = filesystem(name)
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                file, first = fs.open_output_stream(where), doc
                writer = TokenWriter(file, kind)
            writer.add(doc, np.concatenate((encode(text or ""), end)))
    if writer is not None:
        size = writer.close()
        file.close()
        yield batch_of(schema, {"path": [name], "first_doc": [first], "docs": [len(writer.index["docs"])], "ids": [writer.ids], "bytes": [size]})


def _read(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for path, start, size in zip(*(batch[c].to_pylist() for c in ("path", "start", "bytes"))):
            fs, where = filesystem(path)
            with fs.open_input_file(where) as file:
                out, held = [], 0
                for doc, ids in read_tokens(file, size):
                    out.append((doc, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 18:
                        yield batch_of(schema, dict(zip(schema.names, zip(*out))))
                        out, held = [], 0
                if out:
                    yield batch_of(schema, dict(zip(schema.names, zip(*out))))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, kind: str = "byte", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write `docs` to token files below `folder` in ascending doc_id order. Gives the manifest: path, first_doc, docs, ids, bytes."""
    docs = source(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = docs.repartitionByRange(width(docs), "doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(lambda it: _write(it, path, folder, end_id, kind), MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    ahead = Window.orderBy(F.col("first_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(ahead), F.lit(0))).select("path", "start", "bytes")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
