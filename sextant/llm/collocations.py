"""Collocations by pivot partitioning.

Every phrase belongs to its rarest word, its pivot. A first pass counts words. A second one rewrites each
text into fragments: around every word, the neighbours in its piece that no pivot but this word can own
phrases with, words of too low a count left out. Fragments go to the partition of their pivot, equal ones of a
task added up before, and each partition mines alone: it emits only phrases that hold its pivot as the rarest word, so their
counts are whole. Pivots with very many occurrences are dealt over several partitions, whose counts are added.

What "rarest" is must be the same everywhere, and needs no more than one order of all words: the tasks of
the second pass hold a table of fixed size, in which each bucket of a word hash has the highest count
of its words, and order words by that and then by hash. It is the true order but for words that share a bucket with a
more frequent one; counts don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, U64, mix64, prefix_hash, span_hash, spill, text_blocks, tidy, unspill

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP[[32, 9]] = True
_GAP |= _BREAK
ROWS = 1 << 18  # counted rows that a task holds before it adds them up
PARTS = 16  # parts of a language that are ranked apart first
SPREAD = 3  # times the usual number of shuffle partitions that fragments are dealt over


def _cuts(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``data`` (rows end at ``ends``) in parts of about BLOCK_BYTES; a longer row is cut at its breaks, never inside a piece."""
    if len(data) <= 2 * BLOCK_BYTES or len(ends) > 1:
        yield data, ends
        return
    breaks = np.flatnonzero(_BREAK[data])
    lo = 0
    while lo < len(data):
        at = int(np.searchsorted(breaks, lo + BLOCK_BYTES))
        hi = int(breaks[at]) + 1 if at < len(breaks) else len(data)
        yield data[lo:hi], np.asarray([hi - lo])
        lo = hi


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """(words, their piece numbers) of the texts in column 1, block by block, A-Z lower-cased."""
    for _, _, data, off in text_blocks(batch):
        for raw, ends in _cuts(data, off[1:]):
            if not len(raw):
                continue
            buf = _LOWER[raw]
            gap = _GAP[buf]
            edge = np.zeros(len(buf) + 1, bool)
            edge[0] = True
            edge[ends] = True  # rows end here; the next one starts
            lo = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
            if not len(lo):
                continue
            hi = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
            piece = (np.cumsum(_BREAK[buf]) + np.cumsum(edge[:-1]))[lo]
            keep = ~gap
            offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(buf[keep])])
            yield words.dictionary_encode(), piece


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large binary array that starts at 0."""
    off = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    return data, off


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    data, off = _bytes_of(words)
    own = span_hash(prefix_hash(np.frombuffer(lang.encode(), np.uint8)), np.asarray([0]), np.asarray([len(lang.encode())]))[0]
    return mix64(span_hash(prefix_hash(data), off[:-1], off[1:]) ^ own)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    for b in batches:
        for lang in pc.unique(b.column(0)).to_pylist():
            yield lang, b.filter(pc.equal(b.column(0), lang))


def _spans(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The byte spans [lo, hi) of ``data`` as an array."""
    size = hi - lo
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(lo - off[:-1], size) + np.arange(off[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(off), pa.py_buffer(data[at])])


class _Sums:
    """Adds up rows of equal keys, so that a task sends few."""

    def __init__(self, keys: list[str]) -> None:
        self.keys, self.held, self.rows = keys, [], 0

    def add(self, table: pa.Table) -> None:
        self.held.append(table)
        self.rows += table.num_rows

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            out = pa.concat_tables(self.held).group_by(self.keys).aggregate([("n", "sum")])
            out = out.rename_columns([*self.keys, "n"])
            out = out.set_column(out.schema.get_field_index(self.keys[-1]), self.keys[-1], out[self.keys[-1]].cast(pa.large_string()))
            yield from out.to_batches(max_chunksize=1 << 15)
        self.held, self.rows = [], 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums(["lang", "phrase"])
    for lang, b in _by_lang(batches):
        for words, _ in words_of(b):
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            sums.add(pa.table({"lang": pa.array([lang] * len(n), pa.string()), "phrase": words.dictionary, "n": pa.array(n, pa.int64())}))
            if sums.rows > ROWS:
                yield from sums.take()
    yield from sums.take()


def word_order(words: DataFrame, bits: int) -> np.ndarray:
    """The highest count of the words of each of 2**bits buckets; 0 where there is none."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, b in _by_lang(batches):
            h = _hashes(b.column(1).cast(pa.large_binary()).take(pa.array(np.arange(b.num_rows))), lang) >> U64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(2)], ["bucket", "n"])

    found = words.select("lang", "phrase", "n").mapInArrow(tidy(bucket), "bucket long, n long").groupBy("bucket").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def owned(order: np.ndarray, live: np.ndarray, piece: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For every word, how many neighbours left and right of it, ``reach`` at most, its fragment holds.

    Neighbours are of its piece and live, and rarer ones end a fragment; so does the same word on its left,
    which then is the pivot of what holds both.
    """
    n = len(order)
    sides = []
    for left in (True, False):
        got, on = np.zeros(n, np.int64), live.copy()
        for k in range(1, reach + 1):
            near = np.zeros(n, bool)
            if n > k:
                if left:
                    near[k:] = live[:-k] & (piece[:-k] == piece[k:]) & (order[:-k] > order[k:])
                else:
                    near[:-k] = live[k:] & (piece[k:] == piece[:-k]) & (order[k:] >= order[:-k])
            on = on & near
            got += on
        sides.append(got)
    return sides[0], sides[1]


FRAGMENT = "lang string, pivot long, parts int, part int, shape int, phrase string, n long"


def _fragments(table, bits: int, longest: int, hot: int):
    """Texts to fragments: (pivot, words, shape = left * longest + right, n)."""
    reach = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, sums = table.value, _Sums(["lang", "pivot", "parts", "part", "shape", "phrase"])
        for lang, b in _by_lang(batches):
            for words, piece in words_of(b):
                data, off = _bytes_of(words.dictionary)
                h = _hashes(words.dictionary, lang)
                count = top[(h >> U64(64 - bits)).view(np.int64)]
                by = np.lexsort((h, count))
                new = np.concatenate([[0], (h[by][1:] != h[by][:-1]) | (count[by][1:] != count[by][:-1])])
                order = np.empty(len(by), np.int64)
                order[by] = np.cumsum(new)
                code = words.indices.to_numpy()
                left, right = owned(order[code], (count > 0)[code], piece, reach)
                at = np.flatnonzero(left + right)
                if not len(at):
                    continue
                size = np.diff(off)[code] + 1  # with a space behind
                end = np.cumsum(size)
                line = np.full(int(end[-1]), 32, np.uint8)
                inside = np.arange(len(line)) - np.repeat(end - size, size)
                word = inside < np.repeat(size - 1, size)
                line[word] = data[(inside + np.repeat(off[:-1][code], size))[word]]
                first, last = at - left[at], at + right[at]
                text = _spans(line, (end - size)[first], end[last] - 1)
                parts = 1 + count[code[at]] // hot
                part = np.where(parts > 1, (order[code[first]] * 31 + order[code[last]]) % parts, 0)
                sums.add(pa.table({
                    "lang": pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([lang])).cast(pa.string()), "pivot": pa.array(h[code[at]].view(np.int64)), "parts": pa.array(parts, pa.int32()),
                    "part": pa.array(part, pa.int32()), "shape": pa.array(left[at] * longest + right[at], pa.int32()), "phrase": text, "n": pa.array(np.ones(len(at), np.int64)),
                }))
                if sums.rows > ROWS:
                    yield from sums.take()
        yield from sums.take()

    return tidy(run)


def _spans_of_shape(longest: int) -> Column:
    """By shape: (first word, words) of the phrases of a fragment that hold its pivot."""
    shapes = []
    for shape in range(longest * longest):
        left, right = divmod(shape, longest)
        found = [(s, w) for w in range(2, longest + 1) for s in range(max(0, left - w + 1), left + 1) if s + w <= left + 1 + right]
        shapes.append("array(" + ",".join(f"named_struct('s', {s}, 'w', {w})" for s, w in found) + ")" if found else "cast(array() AS array<struct<s:int,w:int>>)")
    return F.expr("array(" + ",".join(shapes) + ")")


def phrase_counts(spark: SparkSession, docs: DataFrame, *, longest: int = 3, least: int = 10, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, w, n) of all phrases of up to ``longest`` words with n >= ``least``, (lang, n) of all words); both written."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(tidy(_count_words), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    # One pass over the counts for both: of the words of a low count only their number is kept, by language and first hash digits.
    kept = F.when(F.col("n") >= least, F.col("phrase"))
    counted = spill(spark, counted.groupBy("lang", kept.alias("phrase"), F.when(kept.isNull(), F.pmod(F.xxhash64("phrase"), F.lit(64))).alias("salt")).agg(F.sum("n").alias("n")))
    totals = spill(spark, counted.groupBy("lang").agg(F.sum("n").alias("n")))
    words = counted.where("phrase IS NOT NULL")
    hot = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // 2_000)
    table = spark.sparkContext.broadcast(word_order(words, bits))

    fragments = texts.mapInArrow(_fragments(table, bits, longest, hot), FRAGMENT)
    # Counting phrases takes far more memory than the fragments that hold them, so they are dealt over more tasks than other shuffles.
    fragments = fragments.repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "pivot", "part")
    spans = F.element_at(_spans_of_shape(longest), F.col("shape") + 1)
    mined = fragments.select("lang", "pivot", "part", "parts", "phrase", "n", F.inline(spans)).select(
        "lang", "pivot", "part", "parts", "w", F.expr("substring_index(substring_index(phrase, ' ', s + w), ' ', -w)").alias("phrase"), "n"
    )
    mined = mined.groupBy("lang", "pivot", "part", "parts", "w", "phrase").agg(F.sum("n").alias("n")).where((F.col("parts") > 1) | (F.col("n") >= least))
    mined = spill(spark, mined.drop("pivot", "part"))
    split = mined.where("parts > 1").groupBy("lang", "w", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    columns = ["lang", "phrase", "w", "n"]
    grams = words.withColumn("w", F.lit(1)).select(columns).unionByName(mined.where("parts = 1").select(columns)).unionByName(split.select(columns))
    grams = spill(spark, grams)
    unspill(counted, mined)
    table.unpersist()
    return grams, totals


def collocations(spark: SparkSession, docs: DataFrame, *, longest: int = 3, least: int = 10, top: int | None = 2_000, inside: int = 50, bits: int = 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of each language (all, if None).

    Pieces end at ``. , ; : ! ?`` and line ends, words at blanks; A-Z are lower-cased. A phrase of 2 to ``longest`` words
    and a count a >= ``least`` is cut where floor(10**6 * a * a / (l * r)) is least, l and r being the counts of its parts; a tie goes to the
    first cut. It is dropped if a longer one holds it and has ``inside`` percent of its count or more.

    A null text is empty, a null lang is ``und``. Every row counts, repeated ones too; texts without words and
    an empty table give nothing. Ties of score and count go by the phrase's bytes. A very long text is read in parts that
    end where pieces do. Only text and lang are read, so other columns don't matter. ``bits`` sizes the table
    of word counts that every task holds, 8 * 2**bits bytes whatever the input.
    """
    grams, totals = phrase_counts(spark, docs, longest=longest, least=least, bits=bits)
    phrases = grams.where("w > 1").withColumnRenamed("n", "a")
    longer = phrases.where("w > 2").select("lang", F.col("a").alias("around"), F.explode(F.expr("array(substring_index(phrase, ' ', w - 1), substring_index(phrase, ' ', 1 - w))")).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(inside) * F.col("a"))).drop("around")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - w)").alias("rest")
    )
    parts = grams.where(F.col("w") < longest)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), wide("l") * wide("r"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    ranked = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:  # a language's best are among its parts' best: the last task reads PARTS * top rows of it at most
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
