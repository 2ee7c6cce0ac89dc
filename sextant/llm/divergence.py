"""How far the sources of a language differ in their words.

A term's share in a group (lang, source) is smoothed, so a term that the group lacks has one too, the
group's zero share z, and the distance of two groups runs over all V kept terms of the language. It is
never computed term by term over V: every pair of groups starts at V * abs(z - z'), and the terms' posting
lists add corrections only where a group has the term:

* one group has it: abs(p - z') - abs(z - z'), summed for all groups at once by running sums over the
  group's own distinct shares, from the highest down;
* both have it: what the two one-sided corrections count too much, -2 * (min(p, p') - max(z, z')), which
  is zero, and not emitted, unless both shares lie above both zero shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.blocks import TokenIndex
from .common import spill, tidy, unspill

#: The bytes of a term: A-Z, a-z and all of signs beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
HELD = 8 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it); null columns count as ''."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of some batches, added up by group and term."""
        lang, source, text = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        lang, source = lang.dictionary_encode(), source.dictionary_encode()
        wide = max(len(source.dictionary), 1)
        group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
        index = TokenIndex(text, TERM)
        many = max(len(lang.dictionary), 1) * wide
        term = np.repeat(np.arange(len(index.terms)), index.frequencies())
        key, at, d = np.unique(term * many + group[index.texts], return_inverse=True, return_counts=True)
        n = np.bincount(at, index.counts, len(key)).astype(np.int64)
        for lo in range(0, len(key), 100_000):
            k = key[lo : lo + 100_000]
            names = [lang.dictionary.take(pa.array(k % many // wide)), source.dictionary.take(pa.array(k % wide)), index.terms.take(pa.array(k // many)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*names, pa.array(n[lo : lo + 100_000]), pa.array(d[lo : lo + 100_000], pa.int64())], ["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= HELD:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    return rows.mapInArrow(tidy(run), "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, size: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * size)), exactly; 0 without kept terms."""
    wide = F.lit(scale).cast("decimal(12,0)") * (n + smoothing).cast("decimal(20,0)")
    part = F.call_function("div", wide, (total + smoothing * size).cast("decimal(20,0)"))
    return F.when(size > 0, 1 + part).otherwise(F.lit(0)).cast("long")


def divergence_audit(spark: SparkSession, docs: DataFrame, *, least: int = 30, smoothing: int = 5, scale: int = 1_000_000_000, top: int = 50, block: int = 256) -> DataFrame:
    """lang, source, part, item, value, rank: parts ``pair`` and ``term`` of every group (lang, source).

    A language keeps the terms that at least ``least`` of its documents hold. ``pair``: every other source of
    the language by distance, the largest first. ``term``: the ``top`` kept terms that the group uses more than its
    language, by how much more. Ties go by the item's bytes.

    Null text, lang and source count as ''. Every row is a document, repeated ones and those without an id too;
    a group without kept terms has the even share of every term, a language without kept terms has distances
    of 0, an empty table gives no rows. Texts are read whole at any length. Only text, lang and source are
    read: other columns don't matter, whatever their names.

    Posting lists are cut into blocks of about ``block`` sources, so that no term's pairs meet in one task.
    """
    of_term, named = Window.partitionBy("lang", "term"), ["lang", "source"]
    counts = term_counts(docs).withColumn("all_d", F.sum("d").over(of_term)).where(F.col("all_d") >= least)
    counts = counts.withColumn("all_n", F.sum("n").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    postings = spill(spark, counts.select(*named, "term", "n", "all_n", "first"))

    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in named)).distinct()
    langs = postings.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("size"), F.sum("n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    totals = postings.groupBy(*named).agg(F.sum("n").alias("total"))
    known = groups.join(sizes, "lang").join(langs, "lang", "left").join(totals, named, "left").fillna(0, ["size", "lang_total", "total"])
    known = spill(spark, known.withColumn("z", share(F.lit(0), F.col("total"), F.col("size"), smoothing, scale)))

    priced = postings.join(known, named)
    p, q = (share(F.col(n), F.col(t), F.col("size"), smoothing, scale) for n, t in (("n", "total"), ("all_n", "lang_total")))
    priced = spill(spark, priced.select(*named, "term", "z", "blocks", p.alias("p"), q.alias("q")))
    unspill(postings)

    by_value = Window.partitionBy(*named).orderBy(F.desc("value"), "item")
    terms = priced.where("p > q").select(*named, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    pairs = distances(known, priced)
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    out = [df.select(*named, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])


def distances(known: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value: from zero counts and corrections."""
    mine, other = known.select("lang", "source", "z", "size"), known.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    probes = mine.join(other, "lang").where("source <> item")
    low, high = F.least("source", "item").alias("low"), F.greatest("source", "item").alias("high")

    # One-sided: H = sum of (p - z') over the group's shares above z'; sum of abs(p - z') = 2 * H - sum of (p - z').
    shares = priced.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("m"))
    own = priced.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k"), F.sum("p").alias("p_sum"))
    events = shares.select("lang", "source", "at", "m", F.lit(None).cast("string").alias("item"), F.lit(None).cast("long").alias("z"), F.lit(None).cast("long").alias("size"))
    events = events.unionByName(probes.select("lang", "source", F.col("other_z").alias("at"), F.lit(0).cast("long").alias("m"), "item", "z", "size"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = events.withColumn("above", F.sum("m").over(down)).withColumn("above_sum", F.sum(F.col("m") * F.col("at")).over(down)).where("item IS NOT NULL")
    run = run.join(own, ["lang", "source"], "left").fillna(0, ["k", "p_sum"])
    apart = F.abs(F.col("z") - F.col("at"))
    one_sided = 2 * (F.col("above_sum") - F.col("above") * F.col("at")) - (F.col("p_sum") - F.col("k") * F.col("at")) - F.col("k") * apart
    baseline = F.when(F.col("source") < F.col("item"), F.col("size") * apart).otherwise(0)
    start = run.select("lang", low, high, (baseline + one_sided).alias("part"))

    # Both-sided: by posting lists; the right side of a list is sent to every block of the left one.
    left = priced.select("lang", "term", F.col("source").alias("low"), F.col("p").alias("lp"), F.col("z").alias("lz"), F.pmod(F.hash("source"), F.col("blocks")).alias("block"))
    right = priced.select("lang", "term", F.col("source").alias("high"), F.col("p").alias("hp"), F.col("z").alias("hz"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shared = F.least("lp", "hp") - F.greatest("lz", "hz")
    both = left.join(right, ["lang", "term", "block"]).where((F.col("low") < F.col("high")) & (shared > 0)).groupBy("lang", "low", "high").agg(F.sum(-2 * shared).alias("part"))

    total = start.unionByName(both).groupBy("lang", "low", "high").agg(F.sum("part").alias("value"))
    ways = F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))
    return total.select("lang", "value", F.inline(ways))
