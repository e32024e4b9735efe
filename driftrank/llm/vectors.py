"""Vectors as blocks of whole numbers: what the operators over embeddings share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components up to here keep every inner product and squared distance of 64 components within a long.
LARGEST = 1 << 27
#: Products of whole numbers are exact in double precision up to here.
EXACT = 1 << 53
NO_ID = np.iinfo(np.int64).max


def whole(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, in double precision, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def usable(vector: Column, factor: int) -> Column:
    """Whether a vector is there and all its components are finite numbers whose whole number is LARGEST at most."""
    top = F.lit(LARGEST / factor)
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < top))
    return vector.isNotNull() & F.coalesce(fits, F.lit(False))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of int64; shorter lists are filled up with zeros."""
    flat, size = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """An integer array in the narrowest type that holds it; the first byte tells which."""
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        if not x.size or info.min <= x.min() and x.max() <= info.max:
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    raise AssertionError


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in int64, exact: in floating point where no sum can exceed what that holds."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of `rows` rows, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(df: DataFrame, rows: int, make: Callable[[pa.Table], dict[str, list]], schema: str) -> DataFrame:
    """One row for each block of `rows` rows at most, made from its table; a block never spans partitions."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches_of(batches, rows):
            made = make(t)
            yield pa.RecordBatch.from_pydict({k: made[k] for k in names})

    return df.mapInArrow(run, schema)
