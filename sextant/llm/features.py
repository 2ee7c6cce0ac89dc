"""Hashed n-gram counts of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, mix64, tidy

_BMP = 0x10000


def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(_BMP)), dtype=bool)


_IS_LETTER: np.ndarray | None = None


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def is_letter(cp: np.ndarray) -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = _letters()
    found = _IS_LETTER[np.minimum(cp, _BMP - 1)]
    for c in np.unique(cp[cp >= _BMP]).tolist():
        found = found | ((cp == c) & chr(c).isalpha())
    return found


def grams(symbols: np.ndarray, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """Bucket numbers of all n-grams of the given orders."""
    s = symbols.astype(U64) + U64(1)
    out, h = [], s * U64(0x9E3779B97F4A7C15)
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(s) < n:
                break
            h = h[:-1] * U64(0xD1342543DE82EF95) + s[n - 1 :]
        if n in orders:
            mixed = mix64(h + U64(n))
            out.append((mixed & U64(buckets - 1) if buckets & (buckets - 1) == 0 else mixed % U64(buckets)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


SCALE = 1 << 30
CLASSES = 200


def _share(rows: DataFrame, label: str, per_class: int, total: int) -> tuple[Column, int]:
    """(of SCALE, the part of each class's rows that a sample takes; rows a class). Only the ``CLASSES`` with the most rows are sampled."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.col("count").desc(), label).limit(CLASSES).collect()}
    per_class = max(1, min(per_class, total // max(len(sizes), 1)))
    share = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(SCALE, SCALE * per_class // n))).otherwise(share)
    return share, per_class


def labelled_keys(labels: DataFrame, key: str, label: str, per_class: int, *, total: int = 30_000) -> DataFrame:
    """About ``per_class`` keys of each class, by a hash of the key: (key, label).

    The bound is a parameter, whatever the size of the table, and ``total`` bounds all classes. A key with several
    labels counts with the smallest.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    share, _ = _share(rows, label, per_class, total)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(SCALE)) < share)


def bounded(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows (doc_id, text, label) of each class, those with the smallest hashes; repeated rows can't swell it."""
    w = Window.partitionBy(label).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= per_class).drop("_place")


def labelled_rows(rows: DataFrame, label: str, per_class: int, *, total: int = 30_000) -> DataFrame:
    """At most ``per_class`` rows (doc_id, text, label) of each class with a label, and about ``total`` in all."""
    rows = rows.where(F.col(label).isNotNull())
    share, per_class = _share(rows.select(label), label, per_class, total)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(SCALE)) < share)
    return bounded(chosen, label, per_class)


def document_frequencies(texts: DataFrame, terms: Callable[[str | None], np.ndarray | None], size: int) -> tuple[np.ndarray, int]:
    """(documents with each of ``size`` terms, documents): one pass over all ``texts``; ``terms`` gives a text's term numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for t in b.column(0).slice(lo, 256).to_pylist():
                    at = terms(t)
                    if at is not None:
                        n[at] += 1
                        n[size] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    sums = texts.mapInArrow(tidy(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 1, np.int64)
    for r in sums.collect():  # at most a row a term
        out[r.term] = r.n
    return out[:size], int(out[size])


def remainder(column: str, modulus: int):
    """crc32 of a column as text, modulo; null for a null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
