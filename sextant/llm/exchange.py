"""Counting keys of a whole corpus without a row for each key.

Texts are packed into pages. A page's distinct 64-bit keys are counted in the page and go out
as packed arrays, one row for each key range; ranges add the counts up, and sums come back as
packed bytes in the order they were sent in. A shuffle carries four or eight bytes a key and
one byte back. A key takes one entry a page however often it comes, and the number of ranges
grows with the data, so a range holds its share of the keys and at most an entry a page of a hot one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, give_back, spill, tidy

PAGE = "page long, size long, ids array<long>, tags array<long>, ends array<long>, data binary, extra binary"
NAMES = [x.split()[0] for x in PAGE.split(", ")]
PAGE_BYTES, PAGE_ROWS = 1 << 20, 1 << 20
RANGE_BYTES = 16 << 20
LISTS = pa.list_(pa.int64())


def ranges_for(spark: SparkSession, pages: DataFrame) -> int:
    """Key ranges for ``pages``: one for every 16 MB of text, and enough for all cores."""
    size = pages.agg(F.sum("size")).first()[0] or 0
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)


class PageWriter:
    """Collects rows (id, tag, bytes) of one task into pages."""

    def __init__(self, page_bytes: int = PAGE_BYTES) -> None:
        self.limit, self.part, self.seq = page_bytes, TaskContext.get().partitionId(), 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.tags, self.texts, self.size = [], [], [], 0

    def add(self, ident: int | None, tag: int | None, text: bytes) -> Iterator[pa.RecordBatch]:
        if self.texts and (self.size + len(text) > self.limit or len(self.texts) >= PAGE_ROWS - 1):
            yield from self.close()
        self.ids.append(ident)
        self.tags.append(tag)
        self.texts.append(text)
        self.size += len(text)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.texts:
            number, self.seq = self.part << 24 | self.seq, self.seq + 1
            yield page_row(number, pa.array(self.ids, pa.int64()), pa.array(self.tags, pa.int64()), np.cumsum([len(t) for t in self.texts]), b"".join(self.texts), b"")
            self._clear()


def page_row(number: int, ids: pa.Array, tags: pa.Array, ends: np.ndarray, data: bytes, extra: bytes) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, tags, pa.array(ends, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data)], pa.int64()), *lists, pa.array([data], pa.binary()), pa.array([extra], pa.binary())], NAMES)


def pages(spark: SparkSession, docs: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """A scratch table of pages of ``docs`` (doc_id, text as binary, tag); any of them may be null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = PageWriter(page_bytes)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                for i, t, g in zip(*(s.column(k).to_pylist() for k in range(3)), strict=True):
                    yield from out.add(i, g, t or b"")
        yield from out.close()

    return spill(spark, docs.select("doc_id", "text", "tag").mapInArrow(tidy(pack), PAGE))


class Page:
    """One page: ids and tags (Arrow, nulls kept), where each text starts and ends, and the bytes."""

    def __init__(self, table, k: int = 0) -> None:
        get = lambda c: table.column(c)[k]
        self.number = get("page").as_py()
        self.ids, self.tags = get("ids").values, get("tags").values
        self.ends = get("ends").values.to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        data = get("data").as_buffer()
        self.data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        extra = get("extra").as_buffer()
        self.extra = extra if extra is not None else b""

    def rows(self) -> np.ndarray:
        """A number for each row that no other row of the table has."""
        return (self.number << 20) + np.arange(len(self.ends), dtype=np.int64)


def _cuts(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys pass from one range to the next, and the ranges."""
    r = ((keys >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int32)
    cut = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]]) if len(r) else np.zeros(1, np.int64)
    return cut, r[cut[:-1]] if len(r) else r


def exchange(pages: DataFrame, keys: Callable[[Page], np.ndarray], use: Callable[[Page, np.ndarray], pa.Table], schema: str, *, ranges: int, exact: bool) -> DataFrame:
    """``use(page, counts)`` of every page, where counts[i] is how often keys(page)[i] comes in all pages.

    With ``exact`` false, four bytes of a key are compared inside its range, and a count may be too high;
    equal keys have equal counts all the same.
    """
    kind = np.dtype("<u8") if exact else np.dtype("<u4")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                page = Page(b, k)
                found, n = np.unique(keys(page), return_counts=True)
                cut, part = _cuts(found, ranges)
                packed, many = [], []
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    packed.append(found[lo:hi].astype(kind).tobytes())
                    at = np.flatnonzero(n[lo:hi] > 1)
                    many.append(np.concatenate([at, n[lo:hi][at]]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([page.number] * len(packed), pa.int64()), pa.array(packed, pa.binary()), pa.array(many, pa.binary())], ["part", "page", "packed", "many"])

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows = group.column("packed").to_pylist()
        size = [len(x) // kind.itemsize for x in rows]
        ends = np.cumsum(size)
        all_keys = np.frombuffer(b"".join(rows), dtype=kind)
        weight = np.ones(len(all_keys), np.int64)
        for end, n, x in zip(ends.tolist(), size, group.column("many").to_pylist(), strict=True):
            at, times = np.frombuffer(x, "<u4").reshape(2, -1).astype(np.int64)
            weight[end - n + at] = times
        order = np.argsort(all_keys, kind="stable")
        s = all_keys[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        counts = np.empty(len(s), np.int64)
        counts[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(s))))
        back, more = [], []
        for end, n in zip(ends.tolist(), size, strict=True):
            own = counts[end - n : end]
            back.append(np.minimum(own, 255).astype(np.uint8).tobytes())
            more.append(own[own >= 255].astype("<u8").tobytes())  # one byte is not enough for these
        out = pa.table({"part": group.column("part"), "page": group.column("page"), "counts": pa.array(back, pa.binary()), "more": pa.array(more, pa.binary())})
        del rows, all_keys, order, s, first, counts, weight, back, more
        give_back()
        return out

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        left = left.combine_chunks()
        for k in range(left.num_rows):
            page = Page(left, k)
            found, where = np.unique(keys(page), return_inverse=True)
            back = sorted(zip(*(right.column(c).to_pylist() for c in ("part", "counts", "more")), strict=True))
            counts = np.frombuffer(b"".join(x[1] for x in back), dtype=np.uint8).astype(np.int64)
            counts[counts == 255] = np.frombuffer(b"".join(x[2] for x in back), dtype="<u8").astype(np.int64)
            made.append(use(page, counts[where] if len(found) else counts))
        return pa.concat_tables(made)

    replies = pages.mapInArrow(tidy(send), "part int, page long, packed binary, many binary").groupBy("part").applyInArrow(count, "part int, page long, counts binary, more binary")
    return pages.groupBy("page").cogroup(replies.groupBy("page")).applyInArrow(answer, schema)
