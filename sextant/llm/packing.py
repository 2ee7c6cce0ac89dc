"""Best-fit packing by exact-complement hashing.

The plan needs only how many pieces of each length there are, at most
``capacity`` numbers. Sums of one, two and three lengths are indexed by their total: from
the longest length down, a piece's gap is looked up among the single lengths, then the pairs, then the
triples, and combinations that fill it exactly are used up while the counts allow it; the rest is packed best fit decreasing.
Each step of the plan serves as many sequences at once as the counts allow. The
plan says which ranks of a length go where; pieces find their place by rank. Pieces
as long as a sequence are one each and need no rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_rows, spill, tidy
from .encode import Encoder, vocabulary
from .token_counts import small


class SumIndex:
    """Pairs and triples of different lengths by their sum, longest member first."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths = np.asarray(sorted(lengths), dtype=np.int64)
        hi, lo = np.tril_indices(len(self.lengths))
        hi, lo = self.lengths[hi], self.lengths[lo]
        fits = hi + lo < capacity
        hi, lo = hi[fits], lo[fits]
        order = np.lexsort((-hi, hi + lo))
        self.hi, self.lo = hi[order], lo[order]
        self.at = np.searchsorted((hi + lo)[order], np.arange(capacity + 1))

    def pairs(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        """(longer, shorter) of all pairs with this sum."""
        if not 0 <= total < len(self.at) - 1:
            return self.hi[:0], self.lo[:0]
        s = slice(self.at[total], self.at[total + 1])
        return self.hi[s], self.lo[s]

    def triples(self, total: int, left: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (x, y, z), x >= y >= z, of the triples with this sum whose x is there, a longest member at a time."""
        for x in self.lengths[(3 * self.lengths >= total) & (self.lengths < total - 1) & (left[self.lengths] > 0)][::-1].tolist():
            y, z = self.pairs(total - x)
            keep = np.searchsorted(-y, -x)  # pairs come longest first
            if keep < len(y):
                yield np.stack([np.full(len(y) - keep, x), y[keep:], z[keep:]], axis=1)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, number of such sequences)] using every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"a piece of length {size}")
        left[size] += n
    made: list[tuple[tuple[int, ...], int]] = []

    def use(*sizes: int) -> None:
        need = Counter(sizes)
        times = min(int(left[s]) // k for s, k in need.items())
        if times:
            for s, k in need.items():
                left[s] -= k * times
            made.append((sizes, times))

    def use_all(size: int, rows: np.ndarray) -> None:
        """Use up the combinations in turn; those with a member that is gone are left out first."""
        while left[size] and len(rows):
            rows = rows[(left[rows] > 0).all(axis=1)]
            for row in rows[:64].tolist():
                use(size, *row)
                if not left[size]:
                    return
            rows = rows[64:]

    index = SumIndex(np.flatnonzero(left).tolist(), capacity)
    for size in range(capacity, 0, -1):
        gap = capacity - size
        if not left[size]:
            continue
        if not gap:
            use(size)
            continue
        use(size, gap)
        use_all(size, np.stack(index.pairs(gap), axis=1))
        for rows in index.triples(gap, left):
            if not left[size]:
                break
            use_all(size, rows)
        there = np.flatnonzero(left)
        if 2 * len(there) < len(index.lengths):  # most lengths are gone
            index = SumIndex(there.tolist(), capacity)
    left = left.tolist()
    # Best fit decreasing on groups of equal open sequences: {free: {lengths: number}}
    open_by: dict[int, dict[tuple[int, ...], int]] = {}
    frees: list[int] = []

    def put(free: int, sizes: tuple[int, ...], n: int) -> None:
        if free not in open_by:
            open_by[free] = {}
            insort(frees, free)
        open_by[free][sizes] = open_by[free].get(sizes, 0) + n

    for size in range(capacity, 0, -1):
        while left[size]:
            k = bisect_left(frees, size)
            if k == len(frees):
                each = max(1, min(capacity // size, left[size]))
                n = left[size] // each
                put(capacity - each * size, (size,) * each, n)
                left[size] -= n * each
                continue
            free = frees[k]
            group = open_by[free]
            sizes, n = group.popitem()
            if not group:
                del open_by[free]
                frees.pop(k)
            m = min(n, left[size])
            if n > m:
                put(free, sizes, n - m)
            put(free - size, (*sizes, size), m)
            left[size] -= m
    made += [(sizes, n) for group in open_by.values() for sizes, n in group.items()]
    return made


def placements(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks of each length with their first sequence and offset, by (length, rank)."""
    rows, used, sequence = [], {}, 0
    for sizes, n in plan:
        offset = 0
        for s in sizes:
            first = used.get(s, 0)
            rows.append((s, first, sequence, offset))
            used[s] = first + n
            offset += s
        sequence += n
    rows.sort()
    table = np.asarray(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(spark: SparkSession, pieces: DataFrame, *, capacity: int = 2_048) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, more).

    Every length must be in 1..capacity. Ranks within a length are counted by (length, salt). A length
    has as many salts as its pieces need, some 4,096 in all beside one a length, whatever the size; a row's salt
    does not depend on its id, so repeated and null ids are dealt as any others. Columns named sequence_id or
    offset are replaced.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = spill(spark, pieces.select(*names, F.monotonically_increasing_id().alias("_row")))
    by = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most capacity rows
    group = hot_rows(sum(by.values()), most=4_096)
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // group)) for k, n in by.items()], "length long, _salts int"))
    dealt = rows.where(F.col("length") < capacity).join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int"))
    counts = dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 4,096 rows
    first: dict[int, int] = {}
    base = []
    for r in sorted(counts):
        base.append((r.length << 32 | r._salt, first.get(r.length, 0)))
        first[r.length] = first.get(r.length, 0) + r.n
    at = placements(plan_packing({k: n for k, n in by.items() if k < capacity}, capacity))
    table = np.asarray(base, dtype=np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((table[:, 0], table[:, 1], at))  # bounded by the capacity, not by the data
    schema = pieces.select(*names).schema
    schema = schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, at = shared.value
        key = at["length"] << 42 | at["rank"]
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            size = get("length")
            rank = base[np.searchsorted(keys, size << 32 | get("_salt"))] + get("_rank") - 1
            k = np.searchsorted(key, size << 42 | rank, side="right") - 1
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at["sequence"][k] + rank - at["rank"][k]), pa.array(at["offset"][k])], [*names, "sequence_id", "offset"])

    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")).cast("long"))
    alone = rows.where(F.col("length") == capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(tidy(place), schema).unionByName(alone)


def token_pieces(docs: DataFrame, *, vocab: str | None = None, capacity: int = 2_048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and the end id, cut at ``capacity``.

    A null or empty text is the end id alone. Rows without a doc_id and repeated rows are cut as any other.
    """
    path = vocab or vocabulary("word_bpe_49k.json")
    end = np.asarray([end_id], dtype="<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)  # goes with the task: loading takes a tenth of a second, keeping it 90 MB a worker
        for b in small(batches):
            row, piece, start, size, crc = [], [], [], [], []
            for i, own in enumerate(enc.encode(b.column(1).to_pylist())):
                ids = np.concatenate([own, end])
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo : lo + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    size.append(len(part))
                    crc.append(zlib.crc32(part))
            arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(spark: SparkSession, docs: DataFrame, *, capacity: int = 2_048, vocab: str | None = None) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows, and rows without a doc_id, are packed as often as they come; pieces of equal length are
    dealt out in no particular order. Texts of any length are cut whole, other columns are not read. An
    empty table gives no rows.
    """
    return pack(spark, token_pieces(docs, vocab=vocab, capacity=capacity), capacity=capacity)
