"""Vectors as packed integers: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batch_of

#: Components that a task turns into numbers at a time; a longer vector comes alone.
SLICE = 1 << 20
#: Two bytes a component up to this magnitude, eight beyond.
NARROW = 1 << 15


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    ends = np.asarray(batch.column(column).offsets)
    ends, start = ends - ends[0], 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def packed(table: DataFrame, vector: str, scale: int, dim: int | None = None) -> DataFrame:
    """The other columns of `table` with `dim`, `wide` and `vec`: each component x of `vector` as the integer floor(scale * x), x as double, in two bytes or, in wide rows, as a double.

    Rows whose vector is null or has a component that is null, infinite or no number are
    left out, with `dim` also those of another number of components.
    """
    others = [f for f in table.schema.fields if f.name != vector]
    out = T.StructType([*others, T.StructField("dim", T.IntegerType()), T.StructField("wide", T.BooleanType()), T.StructField("vec", T.BinaryType())])
    names = [f.name for f in others]

    def part(batches):
        schema = None
        for batch in (s for b in batches for s in _slices(b, vector)):
            column = batch.column(vector)
            ends = np.asarray(column.offsets)
            values = column.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends, size = ends - ends[0], np.diff(ends)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(np.float64(scale) * values)
            at = np.concatenate(([0], np.cumsum(~np.isfinite(whole))))
            keep = np.asarray(column.is_valid()) & (at[ends[1:]] == at[ends[:-1]])
            if dim is not None:
                keep &= size == dim
            large = np.concatenate(([0], np.cumsum(~(np.abs(whole) < NARROW))))
            wide = large[ends[1:]] > large[ends[:-1]]
            with np.errstate(invalid="ignore"):
                narrow = np.where(np.abs(whole) < NARROW, whole, 0).astype("<i2").tobytes()
            chosen = np.flatnonzero(keep)
            vec = [whole[ends[i] : ends[i + 1]].astype("<f8").tobytes() if wide[i] else narrow[2 * ends[i] : 2 * ends[i + 1]] for i in chosen.tolist()]
            rest = batch.select(names).take(pa.array(chosen, pa.int64()))
            if schema is None:
                schema = pa.schema([*rest.schema, ("dim", pa.int32()), ("wide", pa.bool_()), ("vec", pa.binary())])
            yield batch_of(schema, {**{n: rest.column(n) for n in names}, "dim": size[chosen].astype(np.int32), "wide": wide[chosen], "vec": vec})

    return table.mapInArrow(part, out)


def unpacked(vecs: list[bytes], wide: np.ndarray, dim: int) -> np.ndarray:
    """Packed vectors of `dim` components as a matrix of doubles with integer values."""
    out = np.empty((len(vecs), dim))
    for form, rows in (("<i2", np.flatnonzero(~wide)), ("<f8", np.flatnonzero(wide))):
        if len(rows):
            out[rows] = np.frombuffer(b"".join(vecs[i] for i in rows.tolist()), form).reshape(len(rows), dim)
    return out


def largest(matrix: np.ndarray) -> float:
    """The greatest magnitude in a matrix, 0 of an empty one."""
    return float(np.abs(matrix).max()) if matrix.size else 0.0
