"""Rows in blocks, for work that numpy does on many at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StructType

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Batches of 4 MB for what this session plans from here on, if Spark's 64 MB are still set: a worker holds some at a time, on all cores."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(name, "4m")


def packed(df: DataFrame, *, rows: int = 4_096, size: int = 4 << 20) -> DataFrame:
    """One row for about so many rows or bytes of a partition: ``block`` (its number) and every column as an array; no shuffle."""
    names = df.columns
    schema = StructType().add("block", "long")
    for f in df.schema:
        schema = schema.add(f.name, ArrayType(f.dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                cols = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *cols], ["block", *names])
                block += 1

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; a null one is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class TokenIndex:
    """The tokens (as ``functions.text.tokens`` cuts them, or runs of the bytes that ``word`` marks) of a block of texts: a list of (text, count) for each term."""

    def __init__(self, column: pa.Array, word: np.ndarray = _WORD) -> None:
        data, off = texts_of(column)
        n = len(off) - 1
        inside = word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        lo = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])[: len(data)]))
        hi = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])[: len(data)])) + 1
        text = np.searchsorted(off[1:], lo, side="right")
        at = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        self.terms = words.dictionary
        self.lengths = np.bincount(text, minlength=n)
        key, self.counts = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(n, 1) + text, return_counts=True)
        self.texts = key % max(n, 1)
        self.starts = np.searchsorted(key // max(n, 1), np.arange(len(self.terms) + 1))

    def frequencies(self) -> np.ndarray:
        """How many texts have each term."""
        return np.diff(self.starts)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths) of lists of doubles: each at unit length, zeros behind it; a zero vector stays. One that is null
    or holds a null or a non-finite number has length -1 and no components."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.maximum(size, 0)
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(n.max(initial=0))))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    bad = ~np.isfinite(out).all(axis=1)
    out[bad], size[bad] = 0.0, -1
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm == 0, 1.0, norm)[:, None], size


def order_key(value: Any) -> tuple:
    """A key that sorts values of one column as Spark does, nulls first."""
    if isinstance(value, dict):
        value = tuple(order_key(v) for v in value.values())
    elif isinstance(value, list):
        value = tuple(order_key(v) for v in value)
    return (False,) if value is None else (True, value)


def places(column: pa.Array) -> np.ndarray:
    """The place of each value in sorted order; equal values in the order they stand."""
    values = column.to_pylist()
    out = np.empty(len(values), np.int64)
    out[sorted(range(len(values)), key=lambda i: order_key(values[i]))] = np.arange(len(values))
    return out
