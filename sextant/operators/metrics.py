"""Row metrics, summaries, paired comparisons, gates and diagnosis."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIERS = ("single_hop", "multi_hop", "contradiction")


def required_share(answer: Column, terms: Column) -> Column:
    """Share of terms that occur in the answer, in any case; null without terms."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t)))) / F.size(terms))


def forbidden_count(answer: Column, terms: Column) -> Column:
    text = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t)))).cast("long"))


def precision(cited: Column, truth: Column) -> Column:
    """Share of cited elements that are true; null if nothing is cited."""
    return F.try_divide(F.size(F.array_intersect(cited, truth)), F.size(F.array_distinct(cited)))


def recall(cited: Column, truth: Column) -> Column:
    """Share of true elements that are cited; null if nothing is true."""
    return F.try_divide(F.size(F.array_intersect(cited, truth)), F.size(F.array_distinct(truth)))


def abstention(expected: Column, refused: Column) -> Column:
    """1 for a refusal that was due, 0 for one missed or out of place, else null."""
    return F.when(expected & refused, 1.0).when(expected | refused, 0.0)


def summarise(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Long means (by..., metric, value) that ignore nulls; a metric without a value has no row."""
    means = rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot(by, metrics, "metric", "value").where("value is not null")


def paired_means(rows: DataFrame, metric: str) -> DataFrame:
    """(system_a, system_b, n, mean_a, mean_b, mean_diff) of all pairs of systems.

    rows: (system, qid, metric). A pair is void if any question lacks a value on either side.
    """
    total = rows.select("qid").distinct().agg(F.count(F.lit(1)).alias("all"))
    full = rows.where(F.col(metric).isNotNull()).groupBy("system").agg(F.countDistinct("qid").alias("have")).crossJoin(F.broadcast(total)).where("have = all").select("system")
    v = rows.join(F.broadcast(full), "system").select("system", "qid", F.col(metric).cast("double").alias("v"))
    a, b = v.select(F.col("system").alias("system_a"), "qid", F.col("v").alias("a")), v.select(F.col("system").alias("system_b"), "qid", F.col("v").alias("b"))
    return a.join(b, "qid").where("system_a < system_b").groupBy("system_a", "system_b").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"))


def resample_table(spark: SparkSession, n: int, *, resamples: int = 2_000, seed: int = 0) -> DataFrame:
    """(k, picks): the indexes of every resample, by Python's generator, so that an interval is the same anywhere."""
    rng = random.Random(seed)
    return spark.createDataFrame([(k, [rng.randrange(n) for _ in range(n)]) for k in range(resamples)], "k int, picks array<int>")


def bootstrap(spark: SparkSession, pairs: DataFrame, *, resamples: int = 2_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(name, mean_a, mean_b, mean_diff, ci_low, ci_high, n) of pairs (name, qid, a, b), ordered by qid.

    There is one value for each question of a benchmark; all of a name's differences meet in one row, and every
    resample is a task's worth of lookups in it.
    """
    rows = pairs.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("qid", (F.col("a") - F.col("b")).alias("d")))).alias("x"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("d", F.transform("x", lambda e: e["d"])).drop("x")
    sizes = [r.n for r in rows.select("n").distinct().collect()]  # as many as there are sizes of question sets
    if not sizes:
        return rows.select("name", "mean_a", "mean_b", *[F.lit(None).cast("double").alias(c) for c in ("mean_diff", "ci_low", "ci_high")], "n")
    made = None
    for n in sizes:
        part = resample_table(spark, n, resamples=resamples, seed=seed).withColumn("n", F.lit(n).cast("long"))
        made = part if made is None else made.unionByName(part)
    mean = F.aggregate(F.transform("picks", lambda i: F.get("d", i)), F.lit(0.0), lambda s, v: s + v) / F.col("n")
    each = made.join(F.broadcast(rows.select("name", "d", "n")), "n").select("name", mean.alias("m"))  # a name's row is a benchmark's questions
    bounds = each.groupBy("name").agg(F.array_sort(F.collect_list("m")).alias("m"))
    low, high = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1
    return rows.join(bounds, "name").select("name", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("mean_diff"), F.get("m", F.lit(low)).alias("ci_low"), F.get("m", F.lit(high)).alias("ci_high"), "n")


def leaders(wide: DataFrame, metric: str) -> DataFrame:
    """Systems in order: metric falling, refusals rising (none is 0), tokens and latency rising (none is last)."""
    last = F.lit(float("inf"))
    order = [F.col(metric).desc_nulls_last(), F.coalesce("refusal_rate", F.lit(0.0)).asc(), F.coalesce(F.col("tokens").cast("double"), last).asc(), F.coalesce("latency", last).asc(), F.col("system").asc()]
    return wide.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a row for each system


def regression(baseline: DataFrame, candidate: DataFrame, max_drop: float, systems: list[str] | None = None) -> DataFrame:
    """(system, reason, delta) of failures. Inputs: (system, value), a null value being a missing metric.

    Systems that both reports have are compared, or those that are asked for; what is missing then fails. Without a
    system to compare the result is an error.
    """
    b = baseline.select("system", F.col("value").alias("base"), F.lit(True).alias("in_base"))
    c = candidate.select("system", F.col("value").alias("cand"), F.lit(True).alias("in_cand"))
    if systems:
        asked = baseline.sparkSession.createDataFrame([(x,) for x in systems], "system string")
        j = asked.join(b, "system", "left").join(c, "system", "left")
    else:
        j = b.join(c, "system")
        if j.isEmpty():
            raise ValueError("reports have no common systems to compare")
    delta = F.col("cand") - F.col("base")
    reason = (
        F.when(F.col("in_base").isNull(), "missing system in baseline report")
        .when(F.col("in_cand").isNull(), "missing system in candidate report")
        .when(F.col("base").isNull(), "missing metric in baseline report")
        .when(F.col("cand").isNull(), "missing metric in candidate report")
        .when(delta < -max_drop, "metric dropped beyond threshold")
    )
    return j.select("system", reason.alias("reason"), delta.alias("delta")).where("reason is not null")


def headline(r: Column, p: Column) -> Column:
    """100 (0.7 recall + 0.3 precision); null if either is."""
    return 100 * (0.7 * r + 0.3 * p)


def risk(refused: Column, source_recall: Column, required: Column, citation_recall: Column) -> Column:
    zero = F.lit(0.0)
    return F.when(refused, 100.0).otherwise(0.0) + F.coalesce((1 - source_recall) * 30, zero) + F.when(source_recall == 0, 15.0).otherwise(0.0) + F.coalesce((1 - required) * 20, zero) + F.coalesce((1 - citation_recall) * 10, zero)


def issue(refused: Column, source_recall: Column, required: Column, citation_recall: Column, reason: Column | None = None) -> Column:
    said = F.lit("refused") if reason is None else F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("refused: "), reason)).otherwise("refused")
    return F.when(refused, said).when(source_recall == 0, "zero source recall").when(citation_recall < 0.5, "answer citation loss").when(required < 1, "missing required terms").otherwise("lower scoring row")


def bottleneck(m: dict[str, Column], runner: dict[str, Column], primary: str, min_delta: float = 0.03) -> Column:
    """The first limit that holds for a leader's metrics: latency or cost, refusals, citations, generation, retrieval.

    ``m`` and ``runner`` map metric names to columns; ``runner`` is null throughout where there is no second system.
    """
    twice = lambda c: F.coalesce((runner[c] > 0) & (m[c] > 2 * runner[c]), F.lit(False))
    hit = lambda c: F.coalesce(c, F.lit(False))
    pricey = hit(m[primary] - runner[primary] <= min_delta) & (twice("tokens_used_total") | twice("latency_ms_p50"))
    found, kept = m["retrieval_source_recall"], m["must_include_match"]
    weak = hit(m["answer_citation_recall"] < 0.60) | hit(m["answer_citation_precision"] < 0.60)
    return (
        F.when(pricey, "latency_or_cost_limited")
        .when(hit(m["refusal_rate"] > 0.30), "refusal_limited")
        .when(hit(found >= 0.70) & weak, "citation_limited")
        .when(hit((found >= 0.80) & (found - kept >= 0.20)), "generation_limited")
        .when(hit(found < 0.70), "retrieval_limited")
        .otherwise("inconclusive")
    )


def distractor_rate(ranked: DataFrame, distractors: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rate): the share of a question's first k results (qid, doc, rank) that are known to mislead (qid, doc)."""
    known = distractors.select("qid", "doc").distinct().withColumn("_bad", F.lit(1.0))
    return ranked.where(F.col("rank") <= k).join(known, ["qid", "doc"], "left").groupBy("qid").agg(F.avg(F.coalesce("_bad", F.lit(0.0))).alias("rate"))


def latency_sketches(rows: DataFrame, by: list[str], value: str, k: int = 400) -> DataFrame:
    """(by..., sketch): quantile sketches of a value, a few KB each whatever the number of rows. Runs keep them, ``quantiles`` merges them."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.call_function("kll_sketch_agg_double", F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def quantiles(sketches: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by..., n, value): a quantile over all rows behind the sketches of each group; its rank is off by one in a hundred or so."""
    held = F.collect_list("sketch")
    merge = lambda a, b: F.call_function("kll_sketch_merge_double", a, b)
    one = sketches.groupBy(*by).agg(F.reduce(F.slice(held, 2, F.size(held)), held[0], merge).alias("sketch"))
    return one.select(*by, F.call_function("kll_sketch_get_n_double", "sketch").alias("n"), F.call_function("kll_sketch_get_quantile_double", "sketch", F.lit(q)).alias("value"))


def running_budget(ledger: DataFrame, cap: float) -> DataFrame:
    """(account, seq, usd, running, aborted): costs up to each entry, and whether the cap was passed by then."""
    w = Window.partitionBy("account").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("running", F.sum("usd").over(w)).withColumn("aborted", F.round("running", 6) > cap)


def stratified(rows: DataFrame, stratum: str, order: str, n: int, strata: list[str] | None = None) -> DataFrame:
    """The first n of each stratum, with their place. With ``strata``, only those, and one with fewer than n rows is an error."""
    w = Window.partitionBy(stratum).orderBy(order)
    kept = rows.where(F.col(stratum).isin(strata)) if strata else rows
    out = kept.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)
    if strata:
        have = {r[0]: r[1] for r in out.groupBy(stratum).count().collect()}  # a row for each stratum asked for
        if few := [x for x in strata if have.get(x, 0) < n]:
            raise ValueError(f"fewer than {n} rows for: {', '.join(few)}")
    return out
