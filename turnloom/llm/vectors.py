"""Unit vectors packed into bytes: half the size in a shuffle, a scale each, exact to about 1e-5 of a dot product."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: Column, dim: Column) -> Column:
    """Not null, of the right length, without null or NaN, and not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def pack(x: np.ndarray) -> np.ndarray:
    """Rows of unit vectors as rows of bytes: the scale as float32, then an int16 for each number."""
    top = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30).astype(np.float32)
    return np.concatenate([top.view(np.uint8), np.rint(x / top * 32767).astype("<i2").view(np.uint8)], axis=1)


def unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors (float32) of packed rows of equal length."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, 1), np.float32)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(array), -1)
    x = np.ascontiguousarray(raw[:, 4:]).view("<i2").astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def packed(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with ``vector`` (usable arrays of float) replaced by ``packed``, its unit vector in bytes."""
    others = [c for c in df.columns if c != vector]

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for dim in np.unique(lengths):  # one model has one length; a batch can hold several models
                rows = np.flatnonzero(lengths == dim)
                own = batch.take(pa.array(rows))
                if not dim:
                    yield pa.RecordBatch.from_arrays([*[own.column(c) for c in others], pa.array([b""] * len(rows), pa.binary())], names=[*others, "packed"])
                    continue
                x = flat[starts[rows, None] + np.arange(dim)]
                big = np.abs(x).max(axis=1, keepdims=True)
                x = x / big
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in others], binary(pack(x))], names=[*others, "packed"])

    types = dict(df.dtypes)
    return df.select(*others, vector).mapInArrow(convert, ", ".join(f"`{c}` {types[c]}" for c in others) + ", packed binary")
