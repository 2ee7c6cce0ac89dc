"""Shared plumbing: scratch tables, Arrow text blocks, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
U64 = np.uint64


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, deleted when the driver ends.

    Where the setting is absent a temporary folder serves in local mode; on a cluster that is an
    error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/sextant/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        p, files = _hadoop(spark, path)
        files.mkdirs(p)
        files.deleteOnExit(p)
        _FOLDERS.add(path)
    return path


_FOLDERS: set[str] = set()


def _hadoop(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def spill(spark: SparkSession, df: DataFrame, schema=None) -> DataFrame:
    """Write ``df`` as a scratch table and return a scan of it (cuts lineage)."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    # Batches of Spark's 64 MB are held several times over, on both sides of each Python worker.
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "4m")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._sextant_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Batches of 4 MB for what this session plans from here on, if Spark's 64 MB are still set."""
    if spark.conf.get(BATCH_BYTES) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(BATCH_BYTES, "4m")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are written tables by now."""
    for _ in range(2):  # the cleaner works in the background, on what a collection found
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def unspill(*frames: DataFrame) -> None:
    """Delete the scratch tables behind frames that ``spill`` returned."""
    for df in frames:
        path = getattr(df, "_sextant_path", None)
        if path:
            p, files = _hadoop(df.sparkSession, path)
            files.delete(p, True)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, whatever their names and types; one that Spark can't hash (a map, a variant) counts as JSON."""

    def part(f) -> Column:
        c, kind = F.col(f"`{f.name.replace('`', '``')}`"), f.dataType.simpleString()
        return F.to_json(F.struct(c.alias("c"))) if "map<" in kind or "variant" in kind else c

    return F.xxhash64(*[part(f) for f in docs.schema])


def by_name(columns: list[str]) -> list[Column]:
    """Columns by their names, whatever these hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def map_rows(df: DataFrame, run: Callable, columns: list[str] | None = None) -> DataFrame:
    """``df`` through ``run`` over its batches, which have the columns by place: mapInArrow itself stumbles over dots in names.

    The result has the first of the columns again, as many as ``columns`` names (all, if none).
    """
    names = df.columns if columns is None else columns
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.select(*plain.columns[: len(names)]).schema).toDF(*names)


def hot_rows(rows: int, *, least: int = 1_000, most: int = 10_000) -> int:
    """How many of ``rows`` rows a key must have to count as hot: at most ``most`` keys are, whatever the size."""
    return max(least, -(-rows // most))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """Join ``right`` (one row a key) so that no hot key's rows meet in one task.

    ``hot`` marks the rows of ``right`` whose key has more rows in ``left`` than ``hot_rows`` says: few
    enough to be broadcast at any size. The others are shuffled. ``how`` is inner or left.
    """
    hot = F.coalesce(hot, F.lit(False))
    big = right.where(hot)
    rest = left.join(F.broadcast(big.select(*on)), on, "left_anti").join(right.where(~hot), on, how)
    return left.join(F.broadcast(big), on).unionByName(rest)


def give_back() -> None:
    """Return freed memory of this process to the system: Python workers outlive tasks and keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, then ``give_back``."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_blocks(batch: pa.RecordBatch, col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``limit`` text bytes.

    Yields (first row, end row, uint8 bytes of the rows, row offsets into them);
    a null text is empty, and a text above the limit is a block of its own.
    """
    arr = batch.column(batch.schema.get_field_index(col))
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if pa.types.is_large_string(arr.type) or pa.types.is_string_view(arr.type):
        arr = arr.cast(pa.large_string())
        off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    else:
        off = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if len(arr) and arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_SEED = np.random.default_rng(20240229)
BYTE_KEYS = _SEED.integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, BLOCK_BYTES // 4) * 5 // 4 + 1
        got = np.full(size, base, dtype=U64)
        got[0] = 1
        np.cumprod(got, out=got)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = got
    return got[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes modulo 2**64, one longer than ``buf``."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(BYTE_KEYS[buf] * _powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte spans [lo, hi)."""
    return mix64((prefix[hi] - prefix[lo]) * _powers(_INV, len(prefix))[lo])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of ``width`` bytes."""
    n = len(prefix) - width
    return mix64((prefix[width:] - prefix[:n]) * _powers(_INV, len(prefix))[:n]) if n > 0 else np.zeros(0, U64)


class Forest:
    """Union-find over the ids of one task; emits at most one edge an id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        kids = list(self.up)
        return kids, [self.find(x) for x in kids]


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component; alternating stars.

    ``edges`` has columns a and b. Each round is a written table, so a lost
    executor costs one round at most. Nodes without an edge are not returned. The edges of a
    large star's centre are not gathered in one task.

    A round sends its edges twice, each time by their upper end: once for the least neighbour of every node and
    once for the least lower one, where repeats go as well. What it writes may repeat an edge; the last table can't,
    since a table that a round leaves as it is holds one edge for each node.
    """

    def large(e: DataFrame, busy: int) -> DataFrame:
        limit = hot_rows(2 * seen[0])
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if busy <= limit:
            both = both.repartition("a")  # sums and the join share this exchange
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        met = join_hot(both, low, ["a"], F.col("n") > limit) if busy > limit else both.join(low, "a")
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")

    def small(e: DataFrame) -> DataFrame:
        """``e`` has its larger node in a."""
        down = e.repartition("a").distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))
        up = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))  # the least one stays, the others go under it
        return down.select(up.alias("a"), F.col("m").alias("b"))

    def mark(e: DataFrame) -> tuple:
        """Number and sum of the edges, and the largest number of edges at one end."""
        each = e.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        return tuple(each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())

    now = spill(spark, edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct())
    seen = mark(now)
    while seen[0]:
        new = spill(spark, small(large(now, seen[2])))
        unspill(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._sextant_path = now._sextant_path
    return out
