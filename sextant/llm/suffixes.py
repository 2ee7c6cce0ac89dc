"""Repeated byte strings by distributed prefix doubling.

Equal texts are one text. Positions are ranked by their first 50 bytes, then by pairs of ranks 50
bytes apart (100 bytes), then 100 bytes apart (200 bytes): Spark sorts the pairs, equal ones get one new rank,
and positions whose rank is theirs alone drop out. The first two rounds rank sampled
positions only: in every 200-byte string the one of its 101 starts whose first 100 bytes have the smallest name.
Equal strings have it in common, so a string can't repeat unless that start's first 100 bytes do. The last
round ranks every start of a string whose sampled position is left; there are too many of them for a row
each, so their pairs are dealt by range, sorted and compared as packed arrays. For the same reason the
pair's second member is a 64-bit name of its bytes, equal for equal bytes, and no second row of the position table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, by_name, hot_rows, join_hot, map_rows, mix64, prefix_hash, release, spill, tidy, unspill, window_hash
from .exchange import PAGE, Page, PageWriter, exchange, page_row, ranges_for
from .token_counts import small

STEP_BYTES = 1 << 18  # at once; a byte takes several 64-bit names meanwhile
_PAIR = U64(0x9E3779B97F4A7C15)


def _slide(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over all runs of ``width`` values, by blocks of running values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    y = np.full(-(-len(x) // width) * width, fill, dtype=x.dtype)
    y[: len(x)] = x
    y = y.reshape(-1, width)
    ahead = op.accumulate(y, axis=1).reshape(-1)
    back = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    return mix64(a * _PAIR + mix64(b)) | U64(1)


def first_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names of quarter strings, of half strings, smallest half name of each whole string, which starts are whole strings of one document)."""
    half, quarter = length // 2, length // 4
    g = window_hash(prefix_hash(data), quarter)
    h = _pair(g[:-quarter], g[quarter:]) if len(g) > quarter else np.zeros(0, U64)
    low = _slide(h, length - half + 1, np.minimum, 2**64 - 1)
    whole = np.zeros(len(low) + 1, np.int32)
    fits = ends - starts >= length
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - length + 1, -1)
    return g, h, low, np.cumsum(whole[:-1]) > 0


def _steps(page: Page) -> Iterator[tuple[int, int, int, int]]:
    """Runs of whole documents of about STEP_BYTES: (first, end, first byte, end byte)."""
    i = 0
    while i < len(page.ends):
        begin = int(page.starts[i])
        j = max(i + 1, int(np.searchsorted(page.ends, begin + STEP_BYTES, side="right")))
        yield i, j, begin, int(page.ends[j - 1])
        i = j


def distinct_pages(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """Pages of the different texts (column data, binary) of at least ``length`` bytes."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # spares copies in one task the shuffle
        for b in batches:
            for s in small([b], 256):
                texts = [t for t in s.column(0).to_pylist() if t is not None and len(t) >= length]
                own = [hashlib.sha256(t).digest() for t in texts]
                keep = []
                for k, o in enumerate(own):
                    if o not in seen:
                        seen.add(o)
                        keep.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in keep], pa.binary()), pa.array([texts[k] for k in keep], pa.binary())], ["own", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = PageWriter(), set()
        for b in batches:
            for s in small([b], 256):
                for own, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                    if own not in seen:
                        seen.add(own)
                        yield from out.add(None, None, text)
        yield from out.close()

    return spill(spark, docs.select("data").mapInArrow(tidy(first), "own binary, data binary").repartition("own").mapInArrow(tidy(pack), PAGE))


def _sampled(length: int):
    """(a, b, page, n): names of the two quarters at the sampled starts of a page, each pair once, and how often it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, quarter = length // 2, length // 4
        for batch in batches:
            for k in range(batch.num_rows):
                page = Page(batch, k)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i, j, begin, end in _steps(page):
                    g, h, low, whole = first_ranks(page.data[begin:end], page.starts[i:j] - begin, page.ends[i:j] - begin, length)
                    if not whole.any():
                        continue
                    low = np.where(whole, low, U64(0))
                    pad = np.zeros(length - half, U64)
                    high = _slide(np.concatenate([pad, low, pad]), len(pad) + 1, np.maximum, 0)  # over the strings that hold the start
                    at = np.flatnonzero(high[: len(h)] == h[: len(high)])
                    found.append((h[at], g[at], g[at + quarter]))
                if found:
                    h, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                    _, one, n = np.unique(h, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a[one].view(np.int64)), pa.array(b[one].view(np.int64)), pa.array(np.full(len(one), page.number)), pa.array(n, pa.int64())], ["a", "b", "page", "n"])

    return run


RANKED = "part int, run long, a long, b long, page long, n long, last long"


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, a, b, page, n) with the number of their run of equal keys in this task, unless alone in it.

    The task's first and last run may go on in another task and are kept. One more row, without a page, has the number of
    runs (n), the first key (a) and the last one (last).
    """
    part, run, first, last = TaskContext.get().partitionId(), -1, None, None
    held: list[list[np.ndarray]] = []  # of a run so far seen once

    def emit(cols: list[np.ndarray], runs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), part), pa.int32()), pa.array(runs, pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(runs), pa.int64())], ["part", "run", "a", "b", "page", "n", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, *cols = (batch.column(k).to_numpy() for k in range(5))
        new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
        runs = run + np.cumsum(new)
        first = int(key[0]) if first is None else first
        n = np.bincount(runs - runs[0], weights=cols[3])
        if held:
            if runs[0] == run:
                n[0] += 1
                yield emit(held, np.asarray([run]))
            held = []
        elif last is not None and runs[0] == run:
            n[0] += 2  # its earlier rows are out already
        keep = (n[runs - runs[0]] > 1) | (runs == 0)
        if not keep[-1]:
            held = [c[-1:] for c in cols]
        yield emit([c[keep] for c in cols], runs[keep])
        run, last = int(runs[-1]), int(key[-1])
    if held:
        yield emit(held, np.asarray([run]))
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([first], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([run + 1], pa.int64()), pa.array([last], pa.int64())], ["part", "run", "a", "b", "page", "n", "last"])


def rerank(spark: SparkSession, rows: DataFrame, *keys: str) -> DataFrame:
    """Sort ``rows`` (a, b, page, n, maybe rank) by ``keys`` and rank them anew: rank, a, b, page, n of those that are not alone.

    Ranks are dense and global: the runs of all tasks before, and the run's place in its own.
    A key that many rows share is dealt to several tasks by the page.
    """
    key = F.col(keys[0]) if len(keys) == 1 else F.xxhash64(*keys)
    order = ["key", "a", "b", "page"]
    made = spill(spark, rows.select(key.alias("key"), "a", "b", "page", "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_ranks), RANKED))
    base, total, before = [], 0, None
    for r in sorted(made.where("page is null").select("part", "a", "n", "last").collect()):  # a row a task
        total -= r.a == before  # the run goes on
        base.append((r.part, total))
        total, before = total + r.n, r.last
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    out = made.where("page is not null").join(bases, "part").select((F.col("base") + F.col("run")).alias("rank"), "a", "b", "page", "n")
    out._sextant_path = made._sextant_path
    return out


def _left(length: int):
    """Pages cut down to the documents with a sampled start that is left, with the names of those starts."""

    def run(pages: pa.Table, names: pa.Table) -> pa.Table:
        if not pages.num_rows or not names.num_rows:
            return pages.slice(0, 0)
        page = Page(pages.combine_chunks())
        a, b = (names.column(c).to_numpy().astype(np.int64).view(U64) for c in ("a", "b"))
        extra = np.unique(_pair(a, b))
        keep = np.zeros(len(page.ends), bool)
        for i, j, begin, end in _steps(page):
            _, _, low, whole = first_ranks(page.data[begin:end], page.starts[i:j] - begin, page.ends[i:j] - begin, length)
            at = np.flatnonzero(whole & np.isin(low, extra))
            keep[i + np.unique(np.searchsorted(page.ends[i:j] - begin, at, side="right"))] = True
        texts = [page.data[lo:hi].tobytes() for lo, hi, k in zip(page.starts.tolist(), page.ends.tolist(), keep.tolist(), strict=True) if k]
        none = pa.nulls(len(texts), pa.int64())
        if not texts:
            return pages.slice(0, 0)
        return pa.Table.from_batches([page_row(page.number, none, none, np.cumsum([len(t) for t in texts]), b"".join(texts), extra.tobytes())])

    return run


def _doubled(length: int):
    """Keys of a page (the pairs of ranks of strings that may repeat) and what their counts mean."""

    def candidates(page: Page) -> tuple[np.ndarray, np.ndarray]:
        half = length // 2
        extra = np.frombuffer(page.extra, dtype="<u8")
        hits, named = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for i, j, begin, end in _steps(page):
            _, h, low, whole = first_ranks(page.data[begin:end], page.starts[i:j] - begin, page.ends[i:j] - begin, length)
            at = np.flatnonzero(whole & np.isin(low, extra))
            hits.append(at + begin)
            named.append(_pair(h[at], h[at + length - half]))
        return np.concatenate(hits), np.concatenate(named)

    def keys(page: Page) -> np.ndarray:
        return candidates(page)[1]

    def use(page: Page, counts: np.ndarray) -> pa.Table:
        hit = candidates(page)[0][counts > 1]
        cover = np.zeros(len(page.data) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows = []
        for d in np.unique(np.searchsorted(page.ends, hit, side="right")).tolist():
            lo, hi = int(page.starts[d]), int(page.ends[d])
            own = gone[lo:hi]
            spans = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            text = page.data[lo:hi]
            rows.append((hashlib.sha256(text.tobytes()).hexdigest(), int(own.sum()), spans.tolist(), hashlib.sha256(text[~own].tobytes()).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({"own": pa.array(cols[0], pa.string()), "n_removed": pa.array(cols[1], pa.int64()), "spans": pa.array(cols[2], pa.list_(pa.int64())), "kept_sha256": pa.array(cols[3], pa.string())})

    return keys, use


def _bytes():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def repeated_spans(spark: SparkSession, docs: DataFrame, *, length: int = 200) -> DataFrame:
    """own (hex sha256 of the text), n_removed, spans (flat byte starts and ends), kept_sha256, copies.

    One row for each different text with bytes that a repeated string of ``length`` bytes covers, over all rows of
    ``docs`` (column text), those without a doc_id included. Texts are UTF-8 bytes; a null one is empty. ``copies`` is
    the number of its rows where that is above one: such a text repeats as a whole.
    """
    if length < 4 or length % 4:
        raise ValueError("length must be a multiple of four")
    blob = _bytes()
    owns = docs.select(F.sha2(blob, 256).alias("own"), F.octet_length(blob).cast("long").alias("size")).where(F.col("size") >= length)
    copied = spill(spark, owns.groupBy("own").agg(F.max("size").alias("n_removed"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    stored = distinct_pages(spark, docs.select(blob.alias("data")), length)
    release(spark)
    names = spill(spark, stored.mapInArrow(tidy(_sampled(length)), "a long, b long, page long, n long"))
    quarter = rerank(spark, names, "a")
    unspill(names)
    release(spark)
    half = rerank(spark, quarter, "rank", "b")
    left = spill(spark, stored.groupBy("page").cogroup(half.groupBy("page")).applyInArrow(_left(length), PAGE))
    unspill(stored, quarter, half)
    release(spark)
    keys, use = _doubled(length)
    found = spill(spark, exchange(left, keys, use, "own string, n_removed long, spans array<long>, kept_sha256 string", ranges=ranges_for(spark, left), exact=True))
    unspill(left)
    release(spark)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    full = copied.select("own", "n_removed", F.array(F.lit(0).cast("long"), "n_removed").alias("spans"), nothing.alias("kept_sha256"), "copies")
    return full.union(found.join(copied.select("own"), "own", "left_anti").select("own", "n_removed", "spans", "kept_sha256", F.lit(1).cast("long")))


def removal_report(spark: SparkSession, docs: DataFrame, *, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text; other columns are not read).

    Every byte covered by a repeated string goes, in each of its copies. Repeated rows, and rows without a
    doc_id, count as any other: they lend repeats and lose them. A null or empty text has no bytes; an empty
    table gives no rows. Texts of any length are read whole.
    """
    found = repeated_spans(spark, docs, length=length)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(_bytes()).cast("long").alias("n_bytes"), F.sha2(_bytes(), 256).alias("own"))
    joined = join_hot(rows, found, ["own"], F.col("copies") > hot_rows(docs.count()), "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("spans") / 2, F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def remove_repeats(spark: SparkSession, docs: DataFrame, *, length: int = 200) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; bytes of a character cut in two go with it.

    All columns and rows stay, whatever their names; a null text stays null.
    """
    own, cuts = (f"_{x}_{uuid.uuid4().hex}" for x in ("own", "cuts"))
    found = repeated_spans(spark, docs, length=length).select(F.col("own").alias(own), F.col("spans").alias(cuts), F.col("copies").alias(f"{cuts}_n"))
    hot = F.col(f"{cuts}_n") > hot_rows(docs.count())
    names = docs.columns
    joined = join_hot(docs.withColumn(own, F.sha2(_bytes(), 256)), found, [own], hot, "left")
    joined = joined.withColumn("text", F.col("text").cast("string")).select(*by_name(names), cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            cols = [b.column(k) for k in range(len(names))]
            at, spans = names.index("text"), b.column(len(names)).to_pylist()
            texts = cols[at].to_pylist()
            for i, s in enumerate(spans):
                if s is None or texts[i] is None:
                    continue
                raw, end, out = texts[i].encode("utf-8", "surrogatepass"), 0, []
                for lo, hi in zip(s[0::2], s[1::2], strict=True):
                    out.append(raw[end:lo].decode("utf-8", "ignore"))
                    end = hi
                texts[i] = "".join([*out, raw[end:].decode("utf-8", "ignore")])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [f"c{k}" for k in range(len(names))])

    return map_rows(joined, tidy(cut), names)
