"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Words are runs of letters and digits in lower case; a shingle is five words; an
item's windows in a document have as many shingles as the item, and similarity
weighs a shingle by how often it comes (sum of smaller counts over sum of larger ones).

1. Seeds: a window that is similar enough lacks at most a share of 1 - similarity of the item's
   shingles, so it holds one of any larger part of them. Each item is looked up by such a part, the shingles that
   the fewest items have: a phrase that many items share multiplies nothing. Windows without a seed need no fingerprint.
2. Windows start where a seed aligns with the item; unless one of these equals the item,
   at every place from which a window holds a seed, as parts may have moved.
3. Fingerprints of windows and of the items they hold seeds of meet in Hamming blocks: 64 bits in 11 blocks, each
   probed with every value at most one bit away. Two fingerprints within 21 bits have such a block.
4. Pairs within the radius are verified by their exact similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spill

WIDTH = 5
BLOCKS = (6, 6, 6, 6, 6, 6, 6, 6, 6, 5, 5)
RADIUS = 2 * len(BLOCKS) - 1


def shingles(text: Column, width: int = WIDTH) -> Column:
    """array<long>: fingerprints of a text's word shingles; empty for a null or short text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # Bound by a lambda's variable, so that the words are cut once a text.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))))
    return F.coalesce(F.get(made, F.lit(0)), F.array().cast("array<bigint>"))


def bag(hashes: Column) -> Column:
    """The elements numbered by occurrence, so that sets stand for bags."""
    return F.transform(F.array(hashes), lambda a: F.transform(a, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(a, 1, i), lambda x: x == h)))))[0]


def simhash(hashes: Column, width: int = 16) -> Column:
    """64-bit SimHash: a bit is set if more than half of the elements have it. Counters have ``width`` bits (16 or 32)."""
    each, low = 64 // width, (1 << width) - 1
    mask = sum(1 << width * j for j in range(each))

    def counters(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask)))

    sums = [counters(k) for k in range(width)]
    packed = F.transform(F.array(F.struct(F.size(hashes).alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)])), lambda x: reduce(Column.bitwiseOR, [F.shiftleft(F.when(F.shiftrightunsigned(x[f"s{k}"], width * j).bitwiseAND(F.lit(low)) * 2 > x["n"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), width * j + k) for k in range(width) for j in range(each)]))
    return packed[0]


def _blocks(fingerprint: Column, near: bool) -> Column:
    """array<struct<no, value>> of the Hamming blocks; with ``near`` also of values one bit away."""
    out, at = [], 0
    for no, size in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << size) - 1))
        out += [F.struct(F.lit(no).alias("no"), value.bitwiseXOR(F.lit(flip)).cast("long").alias("value")) for flip in ([0, *(1 << b for b in range(size))] if near else [0])]
        at += size
    return F.array(*out)


def meetings(windows: DataFrame, probes: DataFrame) -> DataFrame:
    """Windows (its, f, more) with the items (found, item_f) of theirs that they share a Hamming block with.

    A window meets the items that it holds a seed of: no other one can be similar. So the rows are as many as the seeds' windows,
    times the blocks that agree, however many items there are.
    """
    each = windows.select(*[c for c in windows.columns if c != "its"], F.explode("its").alias("found"))
    blocks = each.select("*", F.explode(_blocks(F.col("f"), False)).alias("b")).select("*", "b.no", "b.value").drop("b")
    return blocks.join(probes, ["found", "no", "value"]).drop("no", "value")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, radius: int = RADIUS, small_items: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, similarity, start, distance: each document with the items that it holds.

    ``start`` is the first shingle of the best window, ``distance`` that of the fingerprints. Items
    with fewer than five words can't be found; null texts and null ids match nothing; rows of
    equal doc_id or item_id count as one with all their texts. Of equally similar windows the first counts,
    then the one with the closer fingerprint. Texts of any length are read whole, other columns not at all; an
    empty table on either side gives no rows. The radius may be lowered, not raised: beyond 21 blocks no
    longer guarantee a meeting.
    """
    if not 0 <= radius <= RADIUS or similarity < 0.8:
        raise ValueError("radius is at most 21 and similarity at least 0.8")
    items = spill(spark, benchmark.where("item_id is not null").select("item_id", shingles(F.col("text").cast("string")).alias("hs")).where("size(hs) > 0").select(F.monotonically_increasing_id().alias("it"), "item_id", "hs", F.size("hs").alias("n")))
    parts = items.select("it", "n", F.posexplode("hs").alias("q", "h"))
    shared = parts.groupBy("h").agg(F.count_distinct("it").alias("items"))
    counted = parts.groupBy("it", "n", "h").agg(F.count(F.lit(1)).alias("times")).join(shared, "h")
    sofar = F.coalesce(F.sum("times").over(Window.partitionBy("it").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = counted.withColumn("before", sofar).where(F.col("before") <= F.floor(F.col("n") * (1 - similarity) + 1e-9)).select("it", "h")
    parts = spill(spark, parts.join(rare, ["it", "h"]).select("it", "n", "q", "h"))
    longest, entries = items.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], parts.count()
    width = 16 if longest < 1 << 16 else 32  # bits that a count of shingles needs
    sized = F.broadcast(parts) if entries <= small_items else parts  # beyond that size, a shuffled join
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seeds = rows.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(shingles(F.col("text"))).alias("p", "h"))
    seeds = spill(spark, seeds.join(sized, "h").select("doc_id", "th", "it", "n", "p", (F.col("p") - F.col("q")).alias("at")).distinct())
    lines = spill(spark, seeds.select("doc_id", "th", "it", "n", "at").distinct())
    held = rows.withColumn("th", F.xxhash64("text")).join(lines.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    held = spill(spark, held.select("doc_id", "th", shingles(F.col("text")).alias("all")))
    item_side = items.select("it", "hs", "n", simhash(F.col("hs"), width).alias("f"), bag(F.col("hs")).alias("bag")).select("it", "n", F.col("f").alias("item_f"), F.col("bag").alias("item_bag"))
    item_side = spill(spark, item_side)
    probes = item_side.select("it", "item_f", F.explode(_blocks(F.col("item_f"), True)).alias("b")).select(F.col("it").alias("found"), "item_f", F.col("b.no").alias("no"), F.col("b.value").alias("value"))

    def verify(starts: DataFrame) -> DataFrame:
        """(doc_id, th, it, start, distance, similarity) of verified windows; starts: doc_id, th, it, n, at."""
        w = starts.join(held, ["doc_id", "th"]).withColumn("start", F.greatest(F.lit(0), F.least(F.col("at"), F.size("all") - F.col("n"))))
        w = w.select("doc_id", "th", "n", "start", "it", F.expr("slice(all, start + 1, n)").alias("hs"))
        w = w.groupBy("doc_id", "th", "n", "start").agg(F.first("hs").alias("hs"), F.collect_set("it").alias("its"))
        w = w.select("doc_id", "th", "n", "start", "its", simhash(F.col("hs"), width).alias("f"))
        met = meetings(w, probes)
        met = met.withColumn("distance", F.bit_count(F.col("f").bitwiseXOR(F.col("item_f")))).where(F.col("distance") <= radius)
        met = met.select("doc_id", "th", "n", "start", "found", "distance").distinct()
        met = met.join(held, ["doc_id", "th"]).withColumn("hs", F.expr("slice(all, start + 1, n)")).join(item_side.select(F.col("it").alias("found"), "item_bag"), "found")
        inter = F.size(F.array_intersect(bag(F.col("hs")), "item_bag"))
        met = met.withColumn("similarity", inter / (F.size("hs") + F.size("item_bag") - inter)).where(F.col("similarity") >= similarity)
        return met.select("doc_id", "th", F.col("found").alias("it"), "start", "distance", "similarity")

    straight = spill(spark, verify(lines))
    rest = seeds.join(straight.where("similarity = 1").select("doc_id", "th", "it").distinct(), ["doc_id", "th", "it"], "left_anti").select("doc_id", "th", "it", "n", "p").distinct()
    before = F.lag("p").over(Window.partitionBy("doc_id", "th", "it", "n").orderBy("p"))
    around = rest.withColumn("first", F.greatest(F.lit(0), F.col("p") - F.col("n") + 1, before + 1))  # each start once
    around = around.select("doc_id", "th", "it", "n", F.explode(F.sequence("first", "p")).alias("at"))
    best = straight.union(verify(around)).join(items.select("it", "item_id"), "it")
    order = F.struct(F.col("similarity"), (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"))
    top = best.groupBy("doc_id", "item_id").agg(F.max(order).alias("o"))
    return top.select("doc_id", "item_id", F.col("o.similarity").alias("similarity"), (-F.col("o.s")).alias("start"), (-F.col("o.d")).alias("distance"))
