"""Ranking operators: BM25, dense vectors, reciprocal-rank fusion.

Queries have (qid, query), documents (doc, ord, text): ord is the corpus order that breaks
ties. Rankings are (qid, doc, ord, score, rank). Scores are rounded to six places before
they are ranked, so that ties are ties on any partitioning.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.blocks import TokenIndex, order_key, packed, places, small_batches, unit_rows
from ..functions.text import strip, tokens
from ..sources.store import workspace

K1, B = 1.5, 0.75
#: Fixed value: scores of one pair that differ by less may come of another order of the sum.
SLACK = 2e-6
#: Fixed value: the part of what is missing to a floor that terms may make up together without their lists being read.
SPARE = 0.8
#: Fixed value: candidates of a query above which the lists left out are read before texts are scored one by one.
MANY = 24
SMALL = 64 << 20


def estimate(df: DataFrame) -> int:
    """The plan's own estimate of a frame's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """A broadcast hint if the plan's own size estimate is below ``limit``, else as it is."""
    return F.broadcast(df) if estimate(df) <= limit else df


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl); at least 1 each, so an empty corpus divides by nothing."""
    return docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qf): repeated terms count."""
    return queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))


def _term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, docs, words): documents with each term; all documents and words under the term ''. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for column in b.column(0):
                index = TokenIndex(column.values)
                terms = pa.concat_arrays([index.terms.cast(pa.string()), pa.array([""])])
                df = np.append(index.frequencies(), 0)
                last = np.arange(len(df)) == len(df) - 1
                yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(last * len(index.lengths), pa.int64()), pa.array(last * int(index.lengths.sum()), pa.int64())], ["term", "df", "docs", "words"])

    counted = packed(docs.select("text")).select("text").mapInArrow(run, "term string, df long, docs long, words long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("words").alias("words"))


def _terms_of(queries: DataFrame) -> DataFrame:
    """(qid, term, qf), and each query once more under the term ''. The texts of one qid count as one."""
    one = queries.groupBy("qid").agg(F.array_join(F.collect_list("query"), " ").alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_024):
                part = b.slice(lo, 1_024)
                index = TokenIndex(part.column(1))
                terms = index.terms.cast(pa.string()).take(pa.array(np.repeat(np.arange(len(index.terms)), index.frequencies())))
                every = np.arange(part.num_rows)
                qid = part.column(0).take(pa.array(np.concatenate([index.texts, every])))
                yield pa.RecordBatch.from_arrays([qid, pa.concat_arrays([terms, pa.array([""] * len(every), pa.string())]), pa.array(np.concatenate([index.counts, 0 * every]), pa.int64())], ["qid", "term", "qf"])

    return one.mapInArrow(run, StructType([queries.schema["qid"], StructField("term", StringType()), StructField("qf", LongType())]))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _avgdl(words: Column, n: Column) -> Column:
    return F.coalesce(F.nullif(words / n, F.lit(0.0)), F.lit(1.0))


def _weighed(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, avgdl, terms, weights) of queries with a term that some document has."""
    met = _terms_of(queries).join(_term_counts(docs), "term")
    one = met.groupBy("qid").agg(F.max("docs").alias("n"), F.max("words").alias("words"), F.collect_list(F.when(F.col("term") != "", F.struct("term", "qf", "df"))).alias("t"))
    weight = lambda t: t["qf"] * _idf(F.col("n"), t["df"])
    return one.where(F.size("t") > 0).select("qid", _avgdl(F.col("words"), F.col("n")).alias("avgdl"), F.transform("t", lambda t: t["term"]).alias("terms"), F.transform("t", weight).alias("weights"))


def _terms_met(common: bool):
    """The common terms of queries, a row each with all of them and how many documents have them; or the others, a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                qid, query, words, df = (b.column(i)[row].values for i in range(4))
                index = TokenIndex(query)
                at = pc.fill_null(pc.index_in(index.terms, value_set=words.cast(pa.large_binary())), -1).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(np.repeat(at >= 0, index.frequencies()) == common)
                known = known[np.argsort(index.texts[known], kind="stable")]
                term = np.repeat(np.arange(len(at)), index.frequencies())[known]
                terms, qf = index.terms.take(pa.array(term)).cast(pa.string()), pa.array(index.counts[known], pa.int64())
                if common:
                    ends = np.concatenate([[0], np.cumsum(np.bincount(index.texts[known], minlength=len(qid)))])
                    met = pa.StructArray.from_arrays([terms, qf, df.take(pa.array(at[term]))], ["term", "qf", "df"])
                    yield pa.RecordBatch.from_arrays([qid, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), met)], ["qid", "t"])
                else:
                    yield pa.RecordBatch.from_arrays([qid.take(pa.array(index.texts[known])), terms, qf], ["qid", "term", "qf"])

    return run


def _weighed_apart(docs: DataFrame, queries: DataFrame, parts: int, at: str, most: int = 1 << 16) -> DataFrame:
    """The rows of ``_weighed`` in so many partitions, by a folder for the counts.

    The ``most`` commonest terms of the documents are broadcast, as many whatever the input; only a query's others, which are few, are rows of a join.
    """
    counts = _written(_term_counts(docs), f"{at}/terms")
    words = counts.where("term <> ''")
    first = words.orderBy(F.desc("df"), "term").limit(most).agg(F.collect_list(F.struct("term", "df")).alias("x"))
    first = first.select(F.col("x.term").alias("words"), F.col("x.df").alias("df"))
    one = packed(queries.repartition(parts, "qid").groupBy("qid").agg(F.array_join(F.collect_list("query"), " ").alias("query")), rows=1_024)
    met = one.crossJoin(F.broadcast(first)).select("qid", "query", "words", "df")
    qid = queries.schema["qid"]
    item = StructType([StructField("term", StringType()), StructField("qf", LongType()), StructField("df", LongType())])
    common = met.mapInArrow(_terms_met(True), StructType([qid, StructField("t", ArrayType(item))]))
    rare = met.mapInArrow(_terms_met(False), StructType([qid, StructField("term", StringType()), StructField("qf", LongType())]))
    rare = rare.join(words.select("term", "df"), "term").select("qid", F.array(F.struct("term", "qf", "df")).alias("t"))
    all_terms = common.where(F.size("t") > 0).union(rare).repartition(parts, "qid").groupBy("qid").agg(F.flatten(F.collect_list("t")).alias("t"))
    total = counts.where("term = ''").select(F.col("docs").alias("n"), "words")  # one row
    weight = lambda t: t["qf"] * _idf(F.col("n"), t["df"])
    return all_terms.crossJoin(F.broadcast(total)).select("qid", _avgdl(F.col("words"), F.col("n")).alias("avgdl"), F.transform("t", lambda t: t["term"]).alias("terms"), F.transform("t", weight).alias("weights"))


def _worth(index: TokenIndex, mean: float) -> np.ndarray:
    """What each entry of an index's lists is worth, before the weight of its term."""
    return index.counts * (K1 + 1) / (index.counts + K1 * (1 - B + B * index.lengths[index.texts] / mean))


def _asked(index: TokenIndex, terms: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, found, weight) of the terms of some queries: where a query's end, their places in the index or -1, their weights."""
    ends, words, weight = terms.offsets.to_numpy(), terms.flatten(), weights.flatten()
    place = lambda x: pc.fill_null(pc.index_in(x.cast(pa.large_binary()), value_set=index.terms), -1).to_numpy(zero_copy_only=False)
    found = place(words.dictionary)[words.indices.to_numpy()] if pa.types.is_dictionary(words.type) else place(words)
    return ends - ends[0], found, weight.dictionary.to_numpy()[weight.indices.to_numpy()] if pa.types.is_dictionary(weight.type) else weight.to_numpy()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _added(index: TokenIndex, worth: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What some terms of a query are worth in each text up to the last that has one, added in their order."""
    lo, hi = index.starts[terms], index.starts[terms + 1]
    at = _ranges(lo, hi)
    return np.bincount(index.texts[at], np.repeat(weights, hi - lo) * worth[at])


def _scored(index: TokenIndex, worth: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray], which) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, texts that have a term of it, their scores) of the queries that have any."""
    ends, found, weight = asked
    for q in which:
        own = np.arange(ends[q], ends[q + 1])
        own = own[found[own] >= 0]
        if len(own):
            score = _added(index, worth, found[own], weight[own])
            hit = np.flatnonzero(score)
            yield q, hit, np.round(score[hit], 6)


class _OfTexts:
    """An index's entries by text, for the scores of a few texts a query: those that ``_scored`` gives."""

    def __init__(self, index: TokenIndex, worth: np.ndarray) -> None:
        order = np.argsort(index.texts, kind="stable")
        self.terms = np.repeat(np.arange(len(index.terms)), index.frequencies())[order]
        self.worth = worth[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(index.texts, minlength=len(index.lengths)))]).astype(np.int64)

    def scores(self, asked: tuple[np.ndarray, np.ndarray, np.ndarray], first: int, query: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a text, 0 without a hit; the queries are some from ``first`` on, in order."""
        ends, found, weight = asked
        last = int(query[-1]) + 1 if len(query) else first
        own = slice(ends[first], ends[last])
        # A query's own terms, and the terms of its texts, as numbers that are equal where both are.
        wide = len(self.terms) + 1
        name = np.where(found[own] >= 0, np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])) * wide + found[own], -1)
        order = np.argsort(name, kind="stable")
        name = name[order]
        lo, hi = self.starts[text], self.starts[text + 1]
        at, pair = _ranges(lo, hi), np.repeat(np.arange(len(text)), hi - lo)
        want = (query[pair] - first) * wide + self.terms[at]
        place = np.minimum(np.searchsorted(name, want), max(len(name) - 1, 0))
        hit = np.flatnonzero(name[place] == want) if len(name) else np.zeros(0, np.int64)
        at, pair, place = at[hit], pair[hit], order[place[hit]]
        order = np.lexsort((place, pair))  # sums in the order of the query's terms
        return np.bincount(pair[order], weight[own][place[order]] * self.worth[at[order]], len(text)).astype(float)  # integers without a pair


def _bounds(index: TokenIndex, worth: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What each term of some queries is worth at most in a text."""
    _, found, weight = asked
    if not len(index.terms):
        return np.zeros(len(found))
    return np.where(found >= 0, weight * np.maximum.reduceat(worth, index.starts[:-1])[found], 0.0)


def _may_reach(index: TokenIndex, worth: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray], floor: np.ndarray) -> np.ndarray:
    """The queries whose terms together are worth ``floor``."""
    of_query = np.repeat(np.arange(len(floor)), np.diff(asked[0]))
    return np.flatnonzero(np.bincount(of_query, _bounds(index, worth, asked), len(floor)) >= floor)


class _Common:
    """The commonest terms of an index as a matrix of what they are worth, a row a term, for products with queries; the others keep their lists."""

    def __init__(self, index: TokenIndex, worth: np.ndarray, most: int = 128, cells: int = 1 << 23) -> None:
        frequency = index.frequencies()
        which = np.argsort(-frequency, kind="stable")[: min(most, cells // max(len(index.lengths), 1))]
        self.index, self.worth = index, worth
        self.row = np.full(len(frequency), -1)
        self.row[which] = np.arange(len(which))
        self.matrix = np.zeros((len(which), len(index.lengths)), np.float32)
        for at, term in enumerate(which):
            own = slice(index.starts[term], index.starts[term + 1])
            self.matrix[at, index.texts[own]] = worth[own]

    def product(self, query: np.ndarray, found: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
        """What the commonest terms of each query are worth in each text, in single precision."""
        row = self.row[found]
        own = row >= 0
        asked = np.zeros((queries, len(self.matrix)), np.float32)
        asked[query[own], row[own]] = weight[own]
        return asked @ self.matrix

    def add(self, scores: np.ndarray, query: np.ndarray, found: np.ndarray, weight: np.ndarray, most: int = 1 << 20) -> None:
        """Add what terms are worth by their lists, about so many entries at a time."""
        lo, hi = self.index.starts[found], self.index.starts[found + 1]
        load, flat, first = np.concatenate([[0], np.cumsum(hi - lo)]), scores.reshape(-1), 0
        while first < len(found):
            last = max(first + 1, int(np.searchsorted(load, load[first] + most, side="right")) - 1)
            own = slice(first, last)
            at, n = _ranges(lo[own], hi[own]), hi[own] - lo[own]
            np.add.at(flat, np.repeat(query[own] * scores.shape[1], n) + self.index.texts[at], (np.repeat(weight[own], n) * self.worth[at]).astype(np.float32))
            first = last


def _off(terms: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How far a sum of so many terms in single precision, of so much at most, may be off, and scores by their order and rounding."""
    return (terms + 4) * 2.0**-23 * total + SLACK


def _kth_best(index: TokenIndex, common: _Common, asked: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, most_cells: int = 1 << 22) -> np.ndarray:
    """A score that k texts of an index reach, for each query, just below the k-th best; -1 where fewer have a hit."""
    ends, found, weight = asked
    queries, texts = len(ends) - 1, len(index.lengths)
    kth = np.full(queries, -1.0)
    if not len(index.terms) or texts < k:
        return kth
    query = np.repeat(np.arange(queries), np.diff(ends))
    off = _off(np.diff(ends), np.bincount(query, _bounds(index, common.worth, asked), queries))
    known = found >= 0
    step = max(1, most_cells // texts)
    for first in range(0, queries, step):
        own = np.flatnonzero(known[ends[first] : ends[min(first + step, queries)]]) + ends[first]
        q, f, w = query[own] - first, found[own], weight[own]
        scores = common.product(q, f, w, min(step, queries - first))
        rare = common.row[f] < 0
        common.add(scores, q[rare], f[rare], w[rare])
        best = np.partition(scores, texts - k, axis=1)[:, texts - k] - off[first : first + step]
        kth[first : first + step] = np.where(best > 0, best, -1.0)
    return kth


def _reaching(index: TokenIndex, worth: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray], floor: np.ndarray, most_cells: int = 1 << 22, k: int | None = None, held: tuple[_Common, _OfTexts] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, texts with a score of ``floor`` or more, their scores); with ``k`` at least those that may be among a query's best k.

    What the commonest terms are worth in every text is a product of matrices. The best of these sums and the floor say how much the
    other terms must add: as far as the commonest of them can't add ``SPARE`` of that together, a text that reaches the floor has
    one of the rest, and only the lists of the rest, the short ones, are read. Texts that may then reach the floor get their score.
    Where these are many, the lists left out are read as well. Some queries at a time, so that a product has about ``most_cells``.
    ``held`` are the index's forms, for a caller that asks it several times.
    """
    ends, found, weight = asked
    texts = len(index.lengths)
    if not len(index.terms):
        return
    query = np.repeat(np.arange(len(floor)), np.diff(ends))
    bounds = _bounds(index, worth, asked)
    total = np.bincount(query, bounds, len(floor))
    live = np.flatnonzero(total >= floor)
    keep = np.flatnonzero((found >= 0) & (total >= floor)[query])
    query, found, weight, bounds, total, floor = np.searchsorted(live, query[keep]), found[keep], weight[keep], bounds[keep], total[live], floor[live]
    queries = len(live)
    ends = np.searchsorted(query, np.arange(queries + 1))
    asked = ends, found, weight
    if not queries:
        return
    common, of_text = held or (_Common(index, worth), _OfTexts(index, worth))
    off = _off(np.diff(ends), total)
    rare = np.flatnonzero(common.row[found] < 0)
    rare = rare[np.lexsort((-index.frequencies()[found[rare]], query[rare]))]
    starts = np.searchsorted(query[rare], np.arange(queries + 1))
    sums = np.concatenate([[0.0], np.cumsum(bounds[rare])])
    step = max(1, most_cells // texts)
    for first in range(0, queries, step):
        last = min(first + step, queries)
        own, lists = slice(ends[first], ends[last]), slice(starts[first], starts[last])
        scores = common.product(query[own] - first, found[own], weight[own], last - first)
        low, wide = floor[first:last], off[first:last]
        at, q = rare[lists], query[rare[lists]] - first
        left = SPARE * (low - scores.max(axis=1) - wide)
        spared = sums[lists.start + 1 : lists.stop + 1] - sums[starts[first:last]][q] < left[q]
        rest = np.bincount(q, bounds[at] * spared, last - first)
        common.add(scores, q[~spared], found[at[~spared]], weight[at[~spared]])
        cell = np.flatnonzero(scores >= (low - rest - wide)[:, None])
        many = np.bincount(cell // texts, minlength=last - first) > MANY
        if many.any():
            more = spared & many[q]
            common.add(scores, q[more], found[at[more]], weight[at[more]])
            found_now = [cell[~many[cell // texts]]]
            for row in np.flatnonzero(many):
                least = low[row] - wide[row]
                if k is not None and k < texts:
                    least = max(least, np.partition(scores[row], texts - k)[texts - k] - 2 * wide[row])
                found_now.append(np.flatnonzero(scores[row] >= least) + row * texts)
            cell = np.sort(np.concatenate(found_now))
        whose, text = cell // texts + first, cell % texts
        parts = [of_text.scores(asked, whose[lo], whose[lo : lo + MANY * 128], text[lo : lo + MANY * 128]) for lo in range(0, len(cell), MANY * 128)]
        s = np.concatenate(parts) if parts else np.zeros(0)
        reach = (s > 0) & (np.round(s, 6) >= floor[whose])
        whose, text, s = whose[reach], text[reach], np.round(s[reach], 6)
        names, starting = np.unique(whose, return_index=True)
        for name, a, b in zip(names, starting, np.append(starting, len(whose))[1:], strict=True):
            yield live[name], text[a:b], s[a:b]


def _best(found: Iterator[tuple[int, np.ndarray, np.ndarray]], tie: np.ndarray, k: int, qid: pa.Array, doc: pa.Array, ordinal: pa.Array) -> list[pa.Array] | None:
    """(qid, doc, ord, score) of the best ``k`` texts of each query (query, texts, scores); nothing without any."""
    at_q, at_d, scores = [], [], []
    for q, hit, s in found:
        if len(hit) > k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            hit, s = hit[keep], s[keep]
        best = np.lexsort((tie[hit], -s))[:k]
        at_q.append(np.full(len(best), q))
        at_d.append(hit[best])
        scores.append(s[best])
    if not at_q:
        return None
    d = pa.array(np.concatenate(at_d))
    return [qid.take(pa.array(np.concatenate(at_q))), doc.take(d), ordinal.take(d), pa.array(np.concatenate(scores))]


def _best_of_block(k: int, late_first: bool):
    """Scores of a block of documents for a block of queries in one array a query; the best ``k`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, tie, flat = None, None, None, 0.0
        for b in batches:
            for row in range(b.num_rows):
                block, doc, ordinal, text, qid, avgdl, terms, weights = (b.column(i)[row] for i in range(8))
                if block.as_py() != held:
                    held, index, flat = block.as_py(), TokenIndex(text.values), 0.0
                    tie = places(ordinal.values)
                    tie = -tie if late_first else tie
                mean = avgdl.values.to_numpy()
                if len(mean) and mean[0] != flat:  # one corpus has one mean
                    flat = mean[0]
                    worth = _worth(index, flat)
                found = _scored(index, worth, _asked(index, terms.values, weights.values), range(len(mean)))
                if got := _best(found, tie, k, qid.values, doc.values, ordinal.values):
                    yield pa.RecordBatch.from_arrays(got, ["qid", "doc", "ord", "score"])

    return run


def _sent(table: pa.Table) -> bytes:
    """A table as compressed bytes, for a row that meets many others."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _received(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _plain(column: pa.ChunkedArray) -> pa.Array:
    """Lists as they were before ``_slices`` numbered their values."""
    column = column.combine_chunks()
    flat = column.flatten()
    return pa.ListArray.from_arrays(pc.subtract(column.offsets, column.offsets[0]), flat.dictionary_decode() if pa.types.is_dictionary(flat.type) else flat)


def _slices(tables: Iterator[pa.Table], rows: int = 1 << 14, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Queries as rows (block, data), each of about so many queries or bytes. Terms and weights are numbers of their distinct values."""
    block, held = TaskContext.get().partitionId() << 32, []

    def row() -> pa.RecordBatch:
        one = pa.concat_tables(held).combine_chunks()
        for c in ("terms", "weights"):
            lists = one[c].combine_chunks()
            one = one.set_column(one.schema.get_field_index(c), c, pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), lists.flatten().dictionary_encode()))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_sent(one)], pa.binary())], ["block", "data"])

    for table in tables:
        held.append(table)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield row()
            block, held[:] = block + 1, []
    if held:
        yield row()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _slices(pa.Table.from_batches([b.slice(lo, 4_096)]) for b in batches for lo in range(0, b.num_rows, 4_096))


def _sliced_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of which little is left, joined."""

    def tables() -> Iterator[pa.Table]:
        for b in batches:
            for data in b.column(0):
                table = _received(data)
                for c in ("terms", "weights"):
                    table = table.set_column(table.schema.get_field_index(c), c, _plain(table[c]))
                yield table

    return _slices(tables())


def _shard_of(rows: pa.Table) -> pa.Table:
    """A row (round, shard, data) of all documents of a shard."""
    if not rows.num_rows:
        return pa.table({"round": pa.array([], pa.int32()), "shard": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
    data = _sent(rows.select(["ord", "text"]))
    return pa.table({"round": rows["round"][:1], "shard": rows["shard"][:1], "data": pa.array([data], pa.binary())})


class _Order:
    """Documents in corpus order, and how many of some that tie come before another one, which need not be among them."""

    def __init__(self, ordinal: pa.Array, late_first: bool) -> None:
        keys = [order_key(v) for v in ordinal.to_pylist()]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys, self.late_first = [keys[i] for i in order], late_first
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.arange(len(keys))

    def before(self, texts: np.ndarray, ordinal) -> int:
        if self.late_first:
            return int((self.place[texts] >= bisect_right(self.keys, order_key(ordinal))).sum())
        return int((self.place[texts] < bisect_left(self.keys, order_key(ordinal))).sum())


def _better_in_shard(k: int, late_first: bool):
    """(block, better) of a shard and a slice of queries: how many documents of the shard come before each candidate of the slice, exact below ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for row in range(b.num_rows):
                number, docs, block, asks = (b.column(i)[row] for i in range(4))
                asks = _received(asks)
                terms, weights, candidates = (asks[c].combine_chunks() for c in ("terms", "weights", "candidates"))
                if number.as_py() != shard:
                    shard, docs = number.as_py(), _received(docs)
                    index, order = TokenIndex(docs["text"].combine_chunks()), _Order(docs["ord"].combine_chunks(), late_first)
                    worth = _worth(index, asks["avgdl"][0].as_py())  # one corpus has one mean
                    held = _Common(index, worth), _OfTexts(index, worth)
                starts, flat = candidates.offsets.to_numpy(), candidates.values
                theirs, ordinal = flat.field("score").to_numpy(), flat.field("ord")
                better = np.zeros(len(theirs), np.int32)
                floor = theirs[starts[1:] - 1] - SLACK  # the best stand first

                def found() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                    for lo in range(0, len(floor), 4_096):  # queries whose terms are held as numbers at a time
                        part = slice(lo, lo + 4_096)
                        for q, hit, score in _reaching(index, worth, _asked(index, terms[part], weights[part]), floor[part], k=k, held=held):
                            yield q + lo, hit, score

                for q, hit, score in found():
                    own = theirs[starts[q] : starts[q + 1]]
                    rising = np.sort(score)
                    upto = np.searchsorted(rising, own, side="right")
                    n = len(score) - upto
                    for i in np.flatnonzero((upto > np.searchsorted(rising, own)) & (n < k)):
                        n[i] += order.before(hit[score == own[i]], ordinal[starts[q] + i].as_py())
                    better[starts[q] : starts[q + 1]] = np.minimum(n, k)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([better], pa.list_(pa.int32()))], ["block", "better"])

    return run


def _still_among(k: int):
    """A slice without the candidates that ``k`` documents come before, and without the queries that have no others."""

    def run(rows: pa.Table) -> pa.Table:
        none = pa.table({"block": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        data = rows["data"].drop_null()
        if not len(data):
            return none
        asks, counts = _received(data[0]), rows["better"].drop_null()
        candidates = asks["candidates"].combine_chunks()
        starts, flat = candidates.offsets.to_numpy(), candidates.values
        better = flat.field("better").to_numpy().astype(np.int64)
        for one in counts.chunks:
            if len(one):
                better = better + one.flatten().to_numpy().reshape(len(one), -1).sum(axis=0)
        better = np.minimum(better, k).astype(np.int32)
        kept = np.flatnonzero(better < k)
        n = np.bincount(np.searchsorted(starts, kept, side="right") - 1, minlength=len(candidates))
        fields = [pa.array(better) if f.name == "better" else flat.field(f.name) for f in flat.type]
        left = pa.StructArray.from_arrays(fields, fields=list(flat.type)).take(pa.array(kept))
        left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), left)
        asks = asks.set_column(asks.schema.get_field_index("candidates"), "candidates", left).take(pa.array(np.flatnonzero(n)))
        return pa.table({"block": rows["block"][:1], "data": pa.array([_sent(asks)], pa.binary())}) if asks.num_rows else none

    return run


def _hits_of_slices(k: int):
    """(qid, doc, ord, score, rank) of the candidates of slices that have met every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                asks = _received(data)
                candidates = asks["candidates"].combine_chunks()
                starts, flat = candidates.offsets.to_numpy(), candidates.flatten()
                score, better = flat.field("score").to_numpy(), flat.field("better").to_numpy()
                whose = np.repeat(np.arange(len(candidates)), np.diff(starts))
                rank = better + 1
                same = (np.diff(whose) == 0) & (np.diff(score) == 0) & (np.diff(better) == 0)
                for i in np.flatnonzero(same):  # documents that nothing puts in an order get a rank each
                    rank[i + 1] = rank[i] + 1
                kept = pa.array(np.flatnonzero(rank <= k))
                cols = [asks["qid"].combine_chunks().take(pa.array(whose)), flat.field("doc"), flat.field("ord"), pa.array(score), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.take(kept) for c in cols], ["qid", "doc", "ord", "score", "rank"])

    return run


def bm25_hits(docs: DataFrame, queries: DataFrame, k: int, *, late_first: bool = True) -> DataFrame:
    """(qid, doc, ord, score, rank): the best k documents that have a term of the query, by BM25.

    Documents are scored in blocks, as numpy arrays: a question and a document meet as numbers in an array, not as rows of
    a shuffle, and a block passes on its k best of each question. Block and question lists are rows, so that Spark deals them out; the
    questions are broadcast if their texts are small, else blocks of both sides are paired by a Cartesian product.
    """
    small_batches(docs.sparkSession)
    weight = queries.agg(F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()[0]
    asks = packed(_weighed(docs, queries), rows=2_048).drop("block")
    blocks = packed(docs.select("doc", "ord", "text"))
    pairs = blocks.crossJoin(F.broadcast(asks) if weight <= SMALL // 4 else asks)
    by = F.col("ord").desc() if late_first else F.col("ord").asc()
    return top(pairs.mapInArrow(_best_of_block(k, late_first), _hit_schema(docs, queries)), k, F.col("score").desc(), by)


def _hit_schema(docs: DataFrame, queries: DataFrame) -> StructType:
    return StructType([StructField(c, df.schema[c].dataType) for c, df in (("qid", queries), ("doc", docs), ("ord", docs))] + [StructField("score", DoubleType())])


def _written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """A frame by way of files, which are read as often as needed; what its plan has shuffled is deleted once they are there."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    kept = [f for f in df.schema if f.name not in by]
    return spark.read.schema(StructType([*kept, *[df.schema[c] for c in by]])).parquet(path)


def _shares_of_terms(index: TokenIndex, vocabulary: pa.Array) -> np.ndarray:
    """A row for each text: the roots of its counts of some terms, at unit length."""
    at = pc.fill_null(pc.index_in(index.terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    at = np.repeat(at, index.frequencies())
    out = np.zeros((len(index.lengths), len(vocabulary)), np.float32)
    out[index.texts[at >= 0], at[at >= 0]] = np.sqrt(index.counts[at >= 0])
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-9)[:, None]


def _sorts(texts: pa.Array, most: int = 8) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(common terms, centres of sorts of texts over them, share of the bytes of each sort) of a few texts, by k-means."""
    index = TokenIndex(texts)
    vocabulary = index.terms.take(pa.array(np.argsort(-index.frequencies(), kind="stable")[:256]))
    rows, size = _shares_of_terms(index, vocabulary), np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
    if not rows.size:
        return vocabulary, rows[:0], np.zeros(0)
    rng = np.random.default_rng(0)
    centres = rows[:1]
    while len(centres) < most:  # far ones are likelier to be the next
        far = np.maximum(1 - (rows @ centres.T).max(axis=1), 0).astype(float) ** 2
        if far.sum() < 1e-6:
            break
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=far / far.sum())]])
    for _ in range(8):
        own = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[own == i].sum(axis=0) for i in range(len(centres)) if (own == i).any()])
        centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1)), 1e-9)[:, None]
    own = (rows @ centres.T).argmax(axis=1)
    return vocabulary, centres, np.bincount(own, size, len(centres)) / size.sum()


def _sorted_out(docs: DataFrame, vocabulary: pa.Array, centres: np.ndarray) -> DataFrame:
    """Documents with the number of the centre that their text is nearest to."""
    words = vocabulary.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.large_binary())
        for b in batches:
            for lo in range(0, b.num_rows, 4_096):
                part = b.slice(lo, 4_096)
                sort = (_shares_of_terms(TokenIndex(part.column("text")), known) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sort, pa.int32())], [*b.schema.names, "sort"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("sort", IntegerType())]))


def _hits_above(docs: DataFrame, asks: DataFrame, k: int, late_first: bool, size: int, some: list, at: str, early: int) -> DataFrame:
    """(qid, doc, ord, score, rank) of the candidates of queries that fewer than ``k`` documents come before.

    Every shard of the documents (their texts have ``size`` bytes) meets every slice of the queries, both of them rows of files: a
    Cartesian product reads these again, so that neither side is written or sent once for each part of the other. What comes back is
    a count for each candidate. With ``early`` above 1 every so manieth document is met first, after which most candidates and
    the queries without others are left out, and the scores that the rest look for are higher.
    A shard holds texts of one sort, as ``some`` texts have them (languages, say): in most shards a query then
    has few of its terms, and is left out there by what they are worth at most.
    """
    vocabulary, centres, share = _sorts(pa.array(some, pa.string()))
    docs = docs.select("doc", "ord", "text")
    if len(centres) < 2:
        share, docs = np.ones(1), docs.withColumn("sort", F.lit(0))
    else:
        docs = _sorted_out(docs, vocabulary, centres)
    parts = [1 / early, 1 - 1 / early] if early > 1 else [1]
    each = np.concatenate([np.maximum(np.ceil(share * (size * part / (SMALL // 2))), 1).astype(int) for part in parts])
    starts = np.cumsum(each) - each
    of_sort = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("round") * len(share) + F.col("sort") + 1).cast("long")
    docs = docs.withColumn("round", F.when(F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(early)) == 0, 0).otherwise(len(parts) - 1))
    docs = docs.withColumn("shard", of_sort(starts) + F.pmod(F.xxhash64("doc"), of_sort(each))).drop("sort", "doc")
    shards = docs.repartition(2 * int(each.sum()), "shard").groupBy("shard").applyInArrow(_shard_of, "round int, shard long, data binary")
    shards = _written(shards, f"{at}/shards", "round").withColumnRenamed("data", "docs")
    slices = asks.mapInArrow(_sliced, "block long, data binary")
    for number in range(len(parts)):
        slices = _written(slices, f"{at}/slices{number}")
        pairs = shards.where(F.col("round") == number).select("shard", "docs").hint("shuffle_replicate_nl").crossJoin(slices)
        counted = pairs.mapInArrow(_better_in_shard(k, late_first), "block long, better array<int>")
        slices = slices.unionByName(counted, allowMissingColumns=True).groupBy("block").applyInArrow(_still_among(k), "block long, data binary")
        if number + 1 < len(parts):
            slices = slices.select("data").mapInArrow(_sliced_again, "block long, data binary")
    found = _written(slices, f"{at}/found").select("data")  # looked for once, however often the caller's plan uses them
    item = asks.schema["candidates"].dataType.elementType
    return found.mapInArrow(_hits_of_slices(k), StructType([asks.schema["qid"], item["doc"], item["ord"], StructField("score", DoubleType()), StructField("rank", LongType())]))


def _kth_of_sample(k: int):
    """Queries, a row each, with a score that k texts of a sample reach; -1 where fewer have a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, common = None, None
        for b in batches:
            for row in range(b.num_rows):
                text, qid, avgdl, terms, weights = (b.column(i)[row] for i in range(5))
                if index is None:
                    index = TokenIndex(text.values)
                    common = _Common(index, _worth(index, avgdl.values[0].as_py()))  # one corpus has one mean
                kth = _kth_best(index, common, _asked(index, terms.values, weights.values), k)
                yield pa.RecordBatch.from_arrays([qid.values, avgdl.values, terms.values, weights.values, pa.array(kth)], ["qid", "avgdl", "terms", "weights", "kth"])

    return run


def _candidates_of_group(k: int, late_first: bool, schema: pa.Schema):
    """Every query of a bucket, with the documents of its group that may be among the first k, best first; without such a document null and no terms."""

    def run(rows: pa.Table) -> pa.Table:
        ask = pc.is_valid(rows["avgdl"])
        asks, docs = rows.filter(ask).combine_chunks(), rows.filter(pc.invert(ask)).combine_chunks()
        if not asks.num_rows:
            return schema.empty_table()
        n, at, scores = np.zeros(asks.num_rows, np.int64), [], []
        if docs.num_rows:
            index, tie = TokenIndex(docs["text"].combine_chunks()), places(docs["ord"].combine_chunks())
            tie = -tie if late_first else tie
            terms, weights, kth = (asks[c].combine_chunks() for c in ("terms", "weights", "kth"))
            kth, worth = kth.to_numpy(), _worth(index, asks["avgdl"][0].as_py())
            own: dict = {}
            for i, g in enumerate(docs["group"].to_pylist()):
                own.setdefault(g, []).append(i)
            own, none = {g: np.array(x) for g, x in own.items()}, np.zeros(0, np.int64)
            of_text, asked = _OfTexts(index, worth), _asked(index, terms, weights)
            theirs = [own.get(g, none) for g in asks["group"].to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in theirs])])
            first = 0
            while first < len(theirs):  # queries with so many pairs at a time
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + MANY * 128, side="right")) - 1)
                text = np.concatenate(theirs[first:last])
                of_pair = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
                score = of_text.scores(asked, first, of_pair, text) if len(text) else np.zeros(0)
                near = np.round(score, 6)
                may = (score > 0) & (near >= kth[of_pair] - SLACK)
                for q in range(first, last):
                    pairs = slice(ends[q] - ends[first], ends[q + 1] - ends[first])
                    hit, s = text[pairs][may[pairs]], near[pairs][may[pairs]]
                    best = np.lexsort((tie[hit], -s))[:k]
                    n[q] = len(best)
                    at.append(hit[best])
                    scores.append(s[best])
                first = last
        settled, offsets = pa.array(n == 0), np.concatenate([[0], np.cumsum(n)])
        which = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
        item = schema.field("candidates").type.value_type
        values = [docs["doc"].combine_chunks().take(which), docs["ord"].combine_chunks().take(which), pa.array(np.concatenate(scores) if at else np.zeros(0)), pa.array(np.zeros(len(which), np.int32))]
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([v.cast(f.type) for v, f in zip(values, item, strict=True)], fields=list(item)), mask=settled)
        empty = lambda c: pc.if_else(settled, pa.scalar([], asks.schema.field(c).type), asks[c].combine_chunks())
        return pa.table({"qid": asks["qid"], "avgdl": asks["avgdl"], "terms": empty("terms"), "weights": empty("weights"), "candidates": found})

    return run


def bm25_hits_of_group(docs: DataFrame, queries: DataFrame, k: int, *, groups: Column, group: Column, late_first: bool = True, sample: int = 4_096, bucket: int = 2_048, early: int = 8) -> DataFrame:
    """The rows of ``bm25_hits`` whose document is of the query's own group, with their ranks among all documents.

    ``group`` is a query's, an expression over qid, ``groups`` an array of those that a document is of, over doc and ord. A query
    without such a row, but with a hit somewhere, has one row that is null but for its qid.

    A sample of the documents shows k better ones than most of a group's, which settles their queries. The others get candidates,
    the documents of the group that may still be among the first k; only documents that reach the worst of these are
    looked for, by the query's rarer terms, and counted. The sample decides how many queries are settled early, never the result.
    """
    small_batches(docs.sparkSession)
    spark, at = docs.sparkSession, workspace(docs.sparkSession)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    every = max(n // sample, size // (SMALL // 4), 1)
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("some"))
    parts = max(2 * spark.sparkContext.defaultParallelism, n // bucket)  # tasks by the work, not by the bytes
    weighed = _written(_weighed_apart(docs, queries, parts, at), f"{at}/weighed")  # so that what was shuffled for it can go
    asks = packed(weighed, rows=2_048).select("qid", "avgdl", "terms", "weights")
    flat = [StructField(f.name, f.dataType.elementType) for f in asks.schema]
    known = asks.crossJoin(F.broadcast(some)).select("some", *asks.columns).mapInArrow(_kth_of_sample(k), StructType([*flat, StructField("kth", DoubleType())]))
    key = lambda g: F.pmod(F.xxhash64(g), F.lit(parts))
    left = known.withColumn("group", group)
    right = docs.select(F.explode(F.array_distinct(groups)).alias("group"), "doc", "ord", "text").where("group is not null")
    met = left.unionByName(right, allowMissingColumns=True).withColumn("bucket", key("group"))
    item = StructType([docs.schema["doc"], docs.schema["ord"], StructField("score", DoubleType()), StructField("better", IntegerType())])
    schema = StructType([*flat, StructField("candidates", ArrayType(item))])
    asked = met.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_candidates_of_group(k, late_first, to_arrow_schema(schema)), schema)
    asked = _written(asked, f"{at}/asked")
    seen = docs.where(F.pmod(F.xxhash64("doc"), F.lit(max(n // 1_024, 1))) == 0).select(F.substring("text", 1, 1_000).alias("text")).limit(2_048)
    hits = _hits_above(docs, asked.where("candidates is not null"), k, late_first, size, [r.text for r in seen.collect()], at, early if n > 2 * early * sample else 1)
    return asked.select("qid").join(hits, "qid", "left")


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each query in the given order, with their rank."""
    w = Window.partitionBy("qid").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def bm25_rank(docs: DataFrame, queries: DataFrame, k: int = 5, *, late_first: bool = True, pad: bool = True) -> DataFrame:
    """Top k by BM25; ties go to the later document, or with ``late_first`` false to the earlier one.

    With ``pad``, documents without a hit follow at score 0, as far as k is not reached. Only the k
    first in tie order that a query has not hit can matter, so k + hits of them are enough; queries
    without a token are padded as well, or with ``pad`` false have no rows.
    """
    hit = bm25_hits(docs, queries, k, late_first=late_first)
    if not pad:
        return hit
    by = F.col("ord").desc() if late_first else F.col("ord").asc()
    # The first 2k documents hold k that are not among a query's at most k hits kept.
    first = docs.select("doc", "ord").orderBy(by).limit(2 * k).agg(F.collect_list(F.struct("doc", "ord")).alias("first"))
    own = hit.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "ord", "score"))).alias("own"))
    rows = queries.select("qid").distinct().join(own, "qid", "left").crossJoin(F.broadcast(first))  # one row of 2k documents
    got = F.transform(F.coalesce("own", F.array().cast(own.schema["own"].dataType)), lambda x: F.struct(x["doc"].alias("doc"), x["ord"].alias("ord"), x["score"].alias("score")))
    rows = rows.select("qid", got.alias("got"), "first")
    rest = F.transform(F.filter("first", lambda x: ~F.exists("got", lambda y: y["doc"].eqNullSafe(x["doc"]))), lambda x: F.struct(x["doc"].alias("doc"), x["ord"].alias("ord"), F.lit(0.0).alias("score")))
    ordered = F.array_sort(F.col("first"), lambda x, y: F.when(x["ord"] == y["ord"], 0).when((x["ord"] > y["ord"]) if late_first else (x["ord"] < y["ord"]), -1).otherwise(1))
    rows = rows.withColumn("first", ordered).select("qid", F.posexplode(F.slice(F.concat("got", rest), 1, k)).alias("at", "x"))
    return rows.select("qid", "x.doc", "x.ord", "x.score", (F.col("at") + 1).cast("long").alias("rank"))


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc) of documents (doc, text) that hold a passage (qid, passage) as it stands.

    A text that holds a passage has its words but the first and last in a row: up to three of them in the middle find the
    candidates by a hash join, which are then compared. Only passages of fewer than three words, which have no word that is
    surely whole, are compared with every text.
    """
    w = tokens(F.col("passage"))

    def seed(x: Column, at: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *[F.get(x, at + i) for i in range(n)])

    middle = lambda x: F.when(F.size(x) >= 5, seed(x, F.floor(F.size(x) / 2).cast("int") - 1, 3)).when(F.size(x) >= 3, seed(x, F.lit(1), 1))
    known = passages.select("qid", "passage", F.transform(F.array(w), middle)[0].alias("seed"), F.coalesce(F.size(w), F.lit(0)).between(3, 4).alias("brief"))
    runs = lambda n: F.transform(F.array(tokens(F.col("text"))), lambda x: F.when(F.size(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: seed(x, i, n)))))[0]

    def met(n: int, which: Column) -> DataFrame:
        asked = small(known.where(F.col("seed").isNotNull() & which).select("seed", "qid"))
        return docs.select("doc", F.explode(runs(n)).alias("seed")).join(asked, "seed").select("doc", "qid")

    verbatim = F.contains("text", "passage")
    seeds = met(3, ~F.col("brief")).union(met(1, F.col("brief")))
    long = docs.join(seeds, "doc").join(small(known.select("qid", "passage")), "qid").where(verbatim)
    short = docs.join(small(known.where("seed is null").select("qid", "passage")), verbatim)
    return long.select("qid", "doc").union(short.select("qid", "doc"))


def _nearest_of_block(k: int, late_first: bool, skip_self: bool):
    """Products of a block of unit vectors with a block of queries, a matrix at a time; the best ``k`` of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit, size, tie, own = None, None, None, None, {}
        for b in batches:
            for row in range(b.num_rows):
                block, doc, ordinal, vec, qid, ask, itself = (b.column(i)[row] for i in range(7))
                if block.as_py() != held:
                    held = block.as_py()
                    unit, size = unit_rows(vec.values)
                    tie = places(ordinal.values)
                    tie = -tie if late_first else tie
                    own = {}
                    for i, x in enumerate(doc.values.to_pylist() if skip_self else ()):
                        own.setdefault(x, []).append(i)
                asked, asked_size = unit_rows(ask.values)
                names = itself.values.to_pylist() if skip_self else None
                width = min(unit.shape[1], asked.shape[1])
                at_q, at_d, scores = [], [], []
                for lo in range(0, len(asked), 64):
                    product = unit[:, :width] @ asked[lo : lo + 64, :width].T
                    product = np.sign(product) * np.floor(np.abs(product) * 1e6 + 0.5) / 1e6 + 0.0
                    product[(size[:, None] != asked_size[lo : lo + 64]) | (size[:, None] < 0)] = -np.inf
                    for q in range(product.shape[1]):
                        s = product[:, q]
                        hit = np.arange(len(s))
                        if skip_self:
                            hit = np.setdiff1d(hit, own.get(names[lo + q], []) + own.get(None, [])) if names[lo + q] is not None else hit[:0]
                        if len(hit) > k:
                            hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k]]
                        best = hit[np.lexsort((tie[hit], -s[hit]))[:k]]
                        at_q.append(np.full(len(best), lo + q))
                        at_d.append(best)
                        scores.append(s[best])
                if at_q:
                    d, s = pa.array(np.concatenate(at_d)), np.concatenate(scores)
                    yield pa.RecordBatch.from_arrays([qid.values.take(pa.array(np.concatenate(at_q))), doc.values.take(d), ordinal.values.take(d), pa.array(s, mask=np.isneginf(s))], ["qid", "doc", "ord", "score"])

    return run


def dense_rank(docs: DataFrame, queries: DataFrame, k: int = 5, *, late_first: bool = True, skip_self: bool = False) -> DataFrame:
    """Top k by the dot product of unit vectors, by brute force: a zero vector has product 0 with all.

    docs: (doc, ord, vec), queries: (qid, vec). Blocks of both sides meet as matrices and pass on the best k of each query; the
    query side is broadcast if it is small. A vector that is null, holds a null or a non-finite component, or differs in length
    from the other scores null, behind all others. With ``skip_self`` a document isn't ranked for the query of its own name.
    """
    wide = F.col("vec").cast("array<double>").alias("vec")
    asks = packed(queries.select("qid", wide, F.col("qid").cast(docs.schema["doc"].dataType).alias("self")), rows=1_024).drop("block")
    blocks = packed(docs.select("doc", "ord", wide)).withColumnRenamed("vec", "own")
    pairs = blocks.crossJoin(F.broadcast(asks) if estimate(queries) <= SMALL else asks)
    schema = StructType([StructField("qid", queries.schema["qid"].dataType), StructField("doc", docs.schema["doc"].dataType), StructField("ord", docs.schema["ord"].dataType), StructField("score", DoubleType())])
    by = F.col("ord").desc() if late_first else F.col("ord").asc()
    return top(pairs.mapInArrow(_nearest_of_block(k, late_first, skip_self), schema), k, F.col("score").desc(), by)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 5, *, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings; ties keep the dense order, then the sparse one."""
    a = dense.select("qid", "doc", "ord", F.col("rank").alias("r1"), F.lit(None).cast("long").alias("r2"))
    b = sparse.select("qid", "doc", "ord", F.lit(None).cast("long").alias("r1"), F.col("rank").alias("r2"))
    share = lambda c: F.coalesce(F.lit(1.0) / (constant + F.col(c)), F.lit(0.0))
    both = a.unionByName(b).groupBy("qid", "doc", "ord").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    both = both.withColumn("score", F.round(share("r1") + share("r2"), 9))
    return top(both, k, F.col("score").desc(), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last())


def chunk_summary_text(summary: Column, text: Column) -> Column:
    """What stands for a chunk in the index: its summary, or the chunk where that is blank."""
    return F.coalesce(F.nullif(strip(F.coalesce(summary, F.lit(""))), F.lit("")), text)


def context(ranked: DataFrame, *, head: str = "[doc:{}]\n", between: str = "\n\n") -> DataFrame:
    """(qid, context) of (qid, rank, chunk_id, text): each text under the mark of its chunk, in rank order."""
    before, _, after = head.partition("{}")
    block = F.concat(F.lit(before), "chunk_id", F.lit(after), "text")
    rows = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return rows.select("qid", F.array_join(F.transform("x", lambda e: e["b"]), between).alias("context"))


def citation(source_path: Column, text: Column, chars: int = 160) -> Column:
    """struct<source_path, span>: a source and the start of what was read of it."""
    return F.struct(source_path.alias("source_path"), F.substring(text, 1, chars).alias("span"))


def first_citations(ranked: DataFrame, chars: int = 160) -> DataFrame:
    """(qid, citations) of (qid, rank, source_path, text): each source once, where it is met first, in rank order."""
    first = ranked.groupBy("qid", "source_path").agg(F.min(F.struct("rank", F.substring("text", 1, chars).alias("span"))).alias("m"))
    order = F.array_sort(F.collect_list(F.struct("m.rank", F.struct("source_path", "m.span").alias("c"))))
    return first.groupBy("qid").agg(F.transform(order, lambda x: x["c"]).alias("citations"))


def answers_of_empty_index(queries: DataFrame, reason: str, answer: str = "") -> DataFrame:
    """(qid, answer, refused, refusal_reason): what a system without anything indexed says to every query."""
    return queries.select("qid", F.lit(answer).alias("answer"), F.lit(True).alias("refused"), F.lit(reason).alias("refusal_reason"))


def rank_quality(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, reciprocal_rank, ndcg) of the first k against gold (qid, doc), both 0 without a hit."""
    rel = ranked.where(F.col("rank") <= k).join(gold.select("qid", "doc").distinct().withColumn("_hit", F.lit(1)), ["qid", "doc"], "left")
    gain = F.when(F.col("_hit") == 1, 1 / F.log2(F.col("rank") + 1))
    got = rel.groupBy("qid").agg(F.coalesce(1 / F.min(F.when(F.col("_hit") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    n = gold.select("qid", "doc").distinct().groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return n.join(got, "qid", "left").select("qid", F.coalesce("reciprocal_rank", F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def rerank(ranked: DataFrame, scorer, k: int = 5) -> DataFrame:
    """Rescore a pool by ``scorer(frame) -> column`` and keep k; ties keep the first ranking."""
    return top(ranked.withColumn("first", F.col("rank")).withColumn("score", scorer(ranked)), k, F.col("score").desc(), F.col("first").asc()).drop("first")
