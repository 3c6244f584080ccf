"""Media columns: content-defined chunks, deduplicated by digest, verified when read back.

A payload is cut where a rolling gear hash of its last 32 bytes has enough zero bits, so
equal stretches get equal chunks wherever they lie. Tasks compress each chunk and append it
to a chunk file in the shared folder; a file never holds a chunk twice. The digests of all
files are deduplicated by joins: one stored place of a digest becomes the place of every
reference to it, and copies in other files are no longer referenced. The digests are joined
once for each file, so a chunk that a third of all media has is no hot key. A medium is the
ordered list of its chunks. Reading takes the chunks from their places, checks every digest
and puts the payload together; chunks that lie one after another are read at once. Bytes
never go through a shuffle.

Null and empty payloads are one block of zeros when padded; a null id is kept; equal rows
are media of their own that share all chunks; a very long payload is more chunks; other
columns, clashing names included, are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, filesystem, slices, source

LEAST, MASK_BITS, MOST = 1024, 12, 16384
#: Digests a task remembers to store a chunk once; after that many it starts afresh.
REMEMBERED = 500_000
#: Bytes that one read takes at most beyond a chunk.
READ = 1 << 22
_GEAR = np.random.default_rng(20240301).integers(0, 1 << 32, 256, np.uint32)
CHUNKS = "array<struct<digest:binary,size:int,path:string,at:bigint,stored:int>>"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' numbers, each shifted by its distance."""
    h, reach = _GEAR[data], 1
    while reach < 32:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def boundaries(hashes: np.ndarray) -> list[int]:
    """Chunk ends of one payload."""
    marks = np.flatnonzero(hashes >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, start, n = [], 0, len(hashes)
    while n - start > LEAST:
        i = np.searchsorted(marks, start + LEAST)
        end = min(int(marks[i]) if i < len(marks) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n or not ends:
        ends.append(n)
    return ends


def _stored(batches, folder: str, unit: int):
    chunk = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("at", pa.int64()), ("stored", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("path", pa.string()), ("row", pa.int64()), ("chunks", pa.list_(chunk))])
    zstd, name, file, at, row, known = zstandard.ZstdCompressor(level=6), f"{folder}/part-{uuid.uuid4().hex}.chunks", None, 0, 0, {}
    for part in slices(batches, "payload"):
        if file is None:
            fs, where = filesystem(name)
            fs.create_dir(where.rpartition("/")[0], recursive=True)
            file = fs.open_output_stream(where)
        out = []
        for key, payload in zip(part["id"].to_pylist(), part["payload"].to_pylist()):
            payload = payload or b""
            n = len(payload)
            payload += bytes(max(unit, -(-n // unit) * unit) - n)
            begin, chunks = 0, []
            for end in boundaries(gear(np.frombuffer(payload, np.uint8))):
                raw, begin = payload[begin:end], end
                digest = xxhash.xxh3_128_digest(raw)
                if digest not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    frame = zstd.compress(raw)
                    file.write(frame)
                    known[digest] = (at, len(frame))
                    at += len(frame)
                chunks.append({"digest": digest, "size": len(raw), "at": known[digest][0], "stored": known[digest][1]})
            out.append((key, n, name, row, chunks))
            row += 1
        yield batch_of(schema, dict(zip(schema.names, zip(*out))))
    if file is not None:
        file.close()


def store(media: DataFrame, folder: str, payload: str, id: str, unit: int = 64) -> DataFrame:
    """Store payloads (binary, padded with zeros to a positive multiple of `unit`). Per row: id, n_bytes, path, row, chunks."""
    media = source(media, id=id, payload=payload).select(F.col("id").cast("long"), F.col("payload").cast("binary"))
    kept = cut(media.mapInArrow(lambda it: _stored(it, folder, unit), "id long, n_bytes long, path string, row long, chunks array<struct<digest:binary,size:int,at:bigint,stored:int>>"))
    parts = kept.select("path", "row", F.posexplode("chunks").alias("k", "c")).select("path", "row", "k", "c.*")
    copies = parts.select("digest", "path", "at", "stored").distinct()  # a chunk once for each file, however many rows refer to it
    places = copies.groupBy("digest").agg(F.min(F.struct("path", "at", "stored")).alias("place"))
    moved = copies.join(places, "digest").select("path", "at", "place")
    listed = parts.select("path", "row", "k", "digest", "size", "at").join(moved, ["path", "at"])
    lists = listed.groupBy("path", "row").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "size", "place"))).alias("chunks"))
    chunks = F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["size"].alias("size"), c["place"]["path"].alias("path"), c["place"]["at"].alias("at"), c["place"]["stored"].alias("stored")))
    return kept.drop("chunks").join(lists.withColumn("chunks", chunks), ["path", "row"])


@lru_cache(maxsize=64)
def _open(path: str):
    fs, where = filesystem(path)
    return fs.open_input_file(where)


def features(payload: bytes) -> str:
    """Features of 8-bit samples: how many, mean, root mean square about it, crossings of the mean, distinct levels."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    return f"n={len(x)};mean={mean:.4f};rms={np.sqrt(np.mean((x - mean) ** 2)):.4f};crossings={int(np.count_nonzero(np.diff(x > mean)))};levels={len(np.unique(x))}"


def joined_places(chunks: list[dict]) -> list[list[dict]]:
    """Runs of chunks that lie one after another in one file: each run is one read."""
    out: list[list[dict]] = []
    for c in chunks:
        last = out[-1][-1] if out else None
        if last and last["path"] == c["path"] and last["at"] + last["stored"] == c["at"] and c["at"] - out[-1][0]["at"] < READ:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def _frames(chunks: list[dict]):
    """The stored bytes of each chunk in order."""
    for run in joined_places(chunks):
        first = run[0]["at"]
        data = _open(run[0]["path"]).read_at(run[-1]["at"] + run[-1]["stored"] - first, first)
        for c in run:
            yield data[c["at"] - first : c["at"] - first + c["stored"]]


def _read(batches):
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string())])
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        out, held = [], 0
        for key, n, chunks in zip(*(batch[c].to_pylist() for c in ("id", "n_bytes", "chunks"))):
            raw, frames = [], []
            for c, frame in zip(chunks, _frames(chunks)):
                piece = unzip.decompress(frame, max_output_size=c["size"])
                if xxhash.xxh3_128_digest(piece) != c["digest"]:
                    raise ValueError(f"chunk at {c['path']}:{c['at']} is damaged")
                raw.append(piece)
                frames.append(frame)
            payload = b"".join(raw)
            out.append((key, n, payload, b"".join(frames), features(payload)))
            held += len(payload)
            if held > 1 << 20:
                yield batch_of(schema, dict(zip(schema.names, zip(*out))))
                out, held = [], 0
        if out:
            yield batch_of(schema, dict(zip(schema.names, zip(*out))))


def read(stored: DataFrame) -> DataFrame:
    """Per medium: id, n_bytes (unpadded), payload, media (its stored chunks in order), feature."""
    n = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.repartition(n, "path").sortWithinPartitions("path", "row").select("id", "n_bytes", "chunks").mapInArrow(_read, "id long, n_bytes long, payload binary, media binary, feature string")
