"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters.

Files hold ranges of doc_id in ascending order. A row is a document with its
ids and its place among the ids of its file; a file's base is the sum of the
files before it, so files and stripes are written and read independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encoder, vocabulary
from .token_counts import small

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def encode_rows(docs: DataFrame, *, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    """Documents in ascending doc_id order with their ids, by range partitions.

    A null text is empty and has the end id alone; rows without a doc_id come
    first; equal doc_ids are ordered by their text's hash and repeated rows stay. Texts of any length are encoded
    whole, other columns are not read, an empty table gives no rows.
    """
    path = vocab or vocabulary("byte_bpe_50k.json")
    end = np.asarray([end_id], dtype="<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for b in small(batches):
            ids = [np.append(x, end) for x in enc.encode(b.column(1).to_pylist())]
            n = np.asarray([len(x) for x in ids], dtype=np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            values = pa.array(np.concatenate(ids).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), b.column(0), pa.array(start), pa.array(n), lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]  # rows of one id may fill several files
    names = ["doc_id", "_text", "_row"]
    rows = rows.select("doc_id", "text", order[1].alias("_text"), order[2].alias("_row"))
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    return rows.mapInArrow(encode, SCHEMA)


def write_orc(docs: DataFrame, path: str, *, vocab: str | None = None, end_id: int = 2, stripe_bytes: int = 16 << 20, index_rows: int = 1_000, false_positives: float = 0.01) -> None:
    """Write the ids of ``docs`` to ORC files under ``path``."""
    (
        encode_rows(docs, vocab=vocab, end_id=end_id)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", false_positives)
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the files; filters on doc_id prune stripes."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a file
    base, total = [], 0
    for r in sizes:
        base.append((r.part, total))
        total += r.n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """Replace ids by the crc32 of their little-endian unsigned 32-bit bytes."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy() * 4
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            sums = [zlib.crc32(data[at[i] : at[i + 1]]) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
