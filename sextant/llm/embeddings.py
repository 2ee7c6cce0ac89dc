"""Near duplicates of vectors by cross-polytope hashing.

Vectors are rotated by random signs and fast Hadamard transforms; the largest
coordinate of a rotation, with its sign, is a hash, and two of them make a table's
bucket. Each vector goes to its best buckets of every table (multiprobe). Candidate
pairs, those with equal labels in a common bucket, are verified by exact cosine.
Equal vectors are one candidate with a multiplicity; a bucket above ``chunk``
candidates is dealt out as pairs of chunks, all of which are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, connected_components, hot_rows, join_hot, spill, tidy, unspill

TABLES, PROBES = 6, 2


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _best(x: np.ndarray, signs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best vertices of a rotation of each row, with their coordinates."""
    for s in signs:
        x = _hadamard(x * s)
    at = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :k]
    v = np.take_along_axis(x, at, axis=1)
    return 2 * at + (v < 0), np.abs(v)


def bucket_codes(vectors: np.ndarray, *, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket numbers, rows x tables x probes, of unit vectors."""
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, probes), dtype=np.int64)
    k = min(probes, width)
    for t in range(tables):
        a, va = _best(x, rng.choice([-1.0, 1.0], (3, width)), k)
        b, vb = _best(x, rng.choice([-1.0, 1.0], (3, width)), k)
        code = (a[:, :, None] * (2 * width) + b[:, None, :]).reshape(n, -1)
        value = (va[:, :, None] + vb[:, None, :]).reshape(n, -1)  # farther vertices lose least first
        best = np.argsort(-value, axis=1, kind="stable")[:, :probes]
        out[:, t, : best.shape[1]] = np.take_along_axis(code, best, axis=1)
        out[:, t, best.shape[1] :] = out[:, t, :1]
    return out


def _units(column: pa.Array, width: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(spark: SparkSession, vectors: DataFrame, *, cosine: float = 0.93, chunk: int = 2_048, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link only if labels are equal and not null and lengths are equal. Null, empty and zero vectors and
    those with null or non-finite components link with nothing. Repeated vec_ids count as vectors of
    their own; a row without a vec_id links with nothing and is its own class. Rows of one vec_id may be in different
    classes. Other columns are not read; an empty table gives no rows. Links are counted exactly among the
    pairs that meet in a bucket.
    """
    kind = dict(vectors.dtypes)["embedding"]
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")).cast("double")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Equal vectors first: one candidate for each. Two hashes with the label name a vector from here on.
    name = [F.xxhash64(F.col("label").cast("string"), "embedding").alias("k1"), F.xxhash64("embedding", F.col("label").cast("string"), F.lit(1)).alias("k2")]
    good = rows.where("usable").select("vec_id", *name, "label", "embedding")
    sets = spill(spark, good.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("rep", F.monotonically_increasing_id()))
    keyed = sets.select("rep", F.xxhash64(F.col("label").cast("string"), F.size("embedding")).alias("group"), F.size("embedding").alias("width"), "embedding")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for width in set(whole.column(2).to_pylist()):
                part = whole.filter(pa.array(np.asarray(whole.column(2)) == width))
                for lo in range(0, part.num_rows, 1_024):
                    b = part.slice(lo, 1_024)
                    c = bucket_codes(_units(b.column(3), width), tables=tables, probes=probes)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * tables * probes, pa.int32()), pa.array(c.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["rep", "group", "codes"])

    coded = spill(spark, keyed.mapInArrow(tidy(codes), "rep long, group long, codes array<long>"))
    places = F.array_distinct(F.transform("codes", lambda c, i: F.struct(F.floor(i / F.lit(probes)).cast("int").alias("tab"), c.alias("code"))))
    entries = coded.select("rep", "group", F.explode(places).alias("x")).select("rep", "group", "x.tab", "x.code")
    sizes = spill(spark, entries.groupBy("group", "tab", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    limit = hot_rows(tables * probes * coded.count())
    # Few small cells for a bucket of some thousands, chunks of ``chunk`` beyond.
    parts = F.greatest(F.ceil(F.col("n") / F.lit(chunk)), F.least(F.lit(16), F.ceil(F.col("n") * 16 / F.lit(chunk)))).cast("int")
    dealt = join_hot(entries, sizes, ["group", "tab", "code"], F.col("n") > limit).withColumn("parts", parts)
    mine = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int")
    # A chunk meets every chunk of its bucket once: the cell is the pair of chunk numbers.
    cells = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("rep", F.xxhash64("group", "tab", "code", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "tab", "code", "mine", (F.col("mine") == F.col("other")).alias("same"))
    payload = coded.join(sets.select("rep", "copies", F.col("embedding").cast("array<double>" if "double" in kind else "array<float>").alias("v")), "rep")
    wide = cells.join(payload, "rep").select("cell", "rep", "tab", "code", "mine", "same", "codes", "copies", "v")
    found = spill(spark, wide.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(_verifier(cosine, probes)), "a long, b long, n long"))
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    roots = connected_components(spark, found.where("b is not null").select("a", "b"))
    known = sets.select("rep", "least", "k1", "k2", "copies").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    known = spill(spark, known.select("k1", "k2", "copies", "least", "root", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    summary = spill(spark, join_hot(known, smallest, ["root"], F.col("members") > hot_rows(known.count())).select("k1", "k2", "copies", "n_links", "component_id"))
    unspill(sets, coded, sizes, found, roots, known)
    hot = F.col("copies") > hot_rows(vectors.count())
    linked = join_hot(good.select("vec_id", "k1", "k2"), summary, ["k1", "k2"], hot).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _verifier(cosine: float, probes: int):
    """Links of each cell: counts of rows and a spanning forest of edges, no pairs."""

    def links(cell: pa.Table, out: dict[int, int], forest: Forest) -> None:
        col = lambda c: cell.column(c).to_numpy()
        rep, mine, copies = col("rep"), col("mine"), col("copies")
        tab, code, across = int(col("tab")[0]), int(col("code")[0]), not cell.column("same")[0].as_py()
        v = _units(cell.column("v").combine_chunks(), len(cell.column("v")[0]))
        codes = np.asarray(cell.column("codes").combine_chunks().flatten()).reshape(len(rep), -1)
        block = 512
        for lo in range(0, len(rep), block):
            sim = v[lo : lo + block] @ v[lo:].T
            i, j = np.nonzero(sim >= cosine)
            i, j = i + lo, j + lo
            ok = j > i
            if across:  # pairs inside a chunk belong to its own cell
                ok &= mine[i] != mine[j]
            i, j = i[ok], j[ok]
            # A pair counts only in the first bucket that both are in.
            first = np.ones(len(i), bool)
            for p in range((tab + 1) * probes):
                base = p // probes * probes
                own = codes[i, p]
                shared = np.zeros(len(i), bool)
                for q in range(base, base + probes):
                    shared |= own == codes[j, q]
                first &= ~(shared if base < tab * probes else shared & (own < code))
            i, j = i[first], j[first]
            for a, n in ((i, copies[j]), (j, copies[i])):
                for k, s in zip(*(x.tolist() for x in _sums(a, n)), strict=True):
                    out[int(rep[k])] = out.get(int(rep[k]), 0) + s
            for a, b in zip(*_tree(i, j, len(rep)), strict=True):
                forest.join(int(rep[a]), int(rep[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by cell: a cell ends where the next begins
            ids = b.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
            out: dict[int, int] = {}
            forest = Forest()
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if held and held[0].column(0)[0].as_py() != ids[lo]:
                    links(pa.Table.from_batches(held), out, forest)
                    held = []
                held.append(b.slice(lo, hi - lo))
            yield from _emit(out, forest)
        if held:
            out, forest = {}, Forest()
            links(pa.Table.from_batches(held), out, forest)
            yield from _emit(out, forest)

    return run


def _tree(i: np.ndarray, j: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Fewer edges than nodes with the components of the edges (i, j)."""
    low = np.arange(n)
    while True:  # the smallest neighbour's label, then its label's label
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    kids = np.flatnonzero(low != np.arange(n))
    return kids.tolist(), low[kids].tolist()


def _sums(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(at, return_inverse=True)
    return keys, np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64)


def _emit(out: dict[int, int], forest: Forest) -> Iterator[pa.RecordBatch]:
    a, b = forest.edges()
    reps = list(out)
    yield pa.RecordBatch.from_arrays([pa.array([*a, *reps], pa.int64()), pa.array([*b, *([None] * len(reps))], pa.int64()), pa.array([*([None] * len(a)), *out.values()], pa.int64())], ["a", "b", "n"])
