"""What a comparison's summary says: leader, findings, bottleneck, weakest tier, next step.

Inputs are the small long tables of evaluation.summary and evaluation.pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import TIERS, bottleneck

USED = ("must_include_match", "answer_citation_precision", "answer_citation_recall", "retrieval_source_recall", "refusal_rate", "tokens_used_total", "latency_ms_p50")
#: What to do about each bottleneck (recommendation, next experiment); {} is the leader, {tier} the weakest tier.
ADVICE = {
    "retrieval_limited": ("Work on retrieval before prompts: even `{}`, the best system here, does not find all the sources it needs.", "Compare a hybrid ranking, a reranker, other embeddings or more results a question{tier}."),
    "generation_limited": ("`{}` finds the sources; what it writes from them is the weak part.", "Vary the answer prompt and the layout of the context, and check answers against their sources."),
    "citation_limited": ("`{}` reads the right sources but its answers do not name them; mend that before release.", "Prescribe the form of citations, or check them after the answer is written."),
    "refusal_limited": ("`{}` declines too many of these questions.", "Look at refused questions that have an answer, and loosen the test for enough evidence."),
    "latency_or_cost_limited": ("What `{}` gains is too little for its extra tokens or time; this run alone is no reason to choose it.", "Ask more questions, or stay with the cheaper second system until the gain holds."),
    "underpowered": ("`{}` comes first, but on too few questions to tell.", "Add questions, first of all{tier_or_weak}."),
    "inconclusive": ("`{}` comes first, and no one weakness explains the rest.", "Read the rows that failed and add questions of their kind."),
    "missing": ("No system has a value for `{}`: pick a metric that the report has, or questions that yield it.", "Run again with that metric filled and two systems or more."),
}
FINDING = "struct<severity:string,code:string,message:string,evidence:map<string,double>>"


def wide(summary: DataFrame, primary: str) -> DataFrame:
    """(system, a column for each metric in use) of the summary's rows over all tiers; NaN is null."""
    names = list(dict.fromkeys([primary, *USED]))
    clean = F.when(~F.isnan("value"), F.col("value"))
    return summary.where("tier is null").groupBy("system").agg(*[F.max(F.when(F.col("metric") == m, clean)).alias(m) for m in names])


def ranked_systems(summary: DataFrame, primary: str, systems: list[str]) -> DataFrame:
    """``wide`` with place: primary metric falling, refusals rising (none is 0), tokens and latency rising (none is last), report order."""
    order = F.create_map(*[x for i, s in enumerate(systems) for x in (F.lit(s), F.lit(i))])
    last = F.lit(float("inf"))
    w = Window.orderBy(F.col(primary).desc(), F.coalesce("refusal_rate", F.lit(0.0)), F.coalesce("tokens_used_total", last), F.coalesce("latency_ms_p50", last), F.try_element_at(order, F.col("system")))
    return wide(summary, primary).where(F.col(primary).isNotNull()).withColumn("place", F.row_number().over(w).cast("long"))  # a row for each system


def weakest_tier(summary: DataFrame, primary: str) -> DataFrame:
    """(system, weakest_tier): the tier with the lowest must_include_match, or primary metric where a system has none; ties in tier order."""
    order = F.create_map(*[x for i, t in enumerate(TIERS) for x in (F.lit(t), F.lit(i))])
    rows = summary.where(F.col("tier").isNotNull() & F.col("metric").isin("must_include_match", primary))
    has = F.max((F.col("metric") == "must_include_match").cast("int")).over(Window.partitionBy("system"))
    used = rows.withColumn("has", has).where(F.when(F.col("has") == 1, F.col("metric") == "must_include_match").otherwise(F.col("metric") == primary) & ~F.isnan("value"))
    key = F.struct("value", F.coalesce(F.try_element_at(order, F.col("tier")), F.lit(len(TIERS))).alias("at"), "tier")
    return used.groupBy("system").agg(F.min(key)["tier"].alias("weakest_tier"))


def _finding(when: Column, severity: str, code: str, message: Column, **evidence: Column) -> Column:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("double"))]
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), F.create_map(*pairs).alias("evidence")))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def diagnose(summary: DataFrame, pairwise: DataFrame, systems: list[str], n_questions: int, *, primary: str = "must_include_match", min_delta: float = 0.03, enough: int = 20) -> DataFrame:
    """One row: primary_metric, leader, runner_up, bottleneck, weakest_tier, recommendation, next_experiment, findings."""
    spark = summary.sparkSession
    ranked = ranked_systems(summary, primary, systems)
    names = list(dict.fromkeys([primary, *USED]))
    first, second = ranked.where("place = 1"), ranked.where("place = 2")
    lead = first.select(F.col("system").alias("leader"), *[F.col(m).alias(f"l_{m}") for m in names])
    run = second.select(F.col("system").alias("runner_up"), *[F.col(m).alias(f"r_{m}") for m in names])
    one = F.broadcast
    row = spark.range(1).join(one(lead), how="left").join(one(run), how="left")  # a row each
    tiers = weakest_tier(summary, primary).withColumnRenamed("system", "leader")
    row = row.join(one(tiers), "leader", "left")
    p = pairwise.where(F.col("metric") == primary)
    ways = p.select(F.col("system_a").alias("leader"), F.col("system_b").alias("runner_up"), "mean_diff", "ci_low", "ci_high").union(p.select("system_b", "system_a", -F.col("mean_diff"), -F.col("ci_high"), -F.col("ci_low")))
    row = row.join(one(ways.dropDuplicates(["leader", "runner_up"])), ["leader", "runner_up"], "left")
    m, r = {c: F.col(f"l_{c}") for c in names}, {c: F.col(f"r_{c}") for c in names}
    row = row.withColumn("bottleneck", F.when(F.col("leader").isNull(), "inconclusive").otherwise(bottleneck(m, r, primary, min_delta)))
    led, two, few = F.col("leader").isNotNull(), F.col("runner_up").isNotNull(), F.lit(n_questions)
    lead_by = m[primary] - r[primary]
    mark = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    num = lambda c: F.format_string("%.3f", c)
    crosses = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    limit = lambda b: F.col("bottleneck") == b
    costly = F.coalesce((r["tokens_used_total"] > 0) & (m["tokens_used_total"] > 2 * r["tokens_used_total"]), F.lit(False))
    interval = {"mean_diff": F.col("mean_diff"), "ci_low": F.col("ci_low"), "ci_high": F.col("ci_high")}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = F.array(
        _finding(~led, "critical", "PRIMARY_METRIC_MISSING", F.lit(f"`{primary}` has no value for any system.")),
        _finding(led & (few < enough), "warning", "UNDERPOWERED_EVAL", F.lit(f"{n_questions} questions show a direction at most."), n_questions=few, min_questions_for_confidence=F.lit(enough)),
        _finding(two & (lead_by < min_delta), "warning", "SMALL_LEADER_DELTA", _text(mark("leader"), " is ", num(lead_by), " ahead of ", mark("runner_up"), f"; less than {min_delta:.3f} counts as level."), leader_value=m[primary], runner_up_value=r[primary], delta=lead_by, min_meaningful_delta=F.lit(min_delta)),
        _finding(two & F.col("mean_diff").isNull() & (few >= 5), "warning", "PAIRWISE_UNAVAILABLE", _text(mark("leader"), " and ", mark("runner_up"), f" have no paired interval for `{primary}`."), n_questions=few),
        _finding(two & crosses, "warning", "LEADER_CI_CROSSES_ZERO", _text("The paired interval of ", mark("leader"), " against ", mark("runner_up"), " holds zero."), **interval),
        _finding(two & ~crosses, "info", "LEADER_CI_DIRECTIONAL", _text("The paired interval of ", mark("leader"), " against ", mark("runner_up"), " lies on one side of zero."), **interval),
        _finding(led & ~two & (few < 5), "warning", "PAIRWISE_NOT_RUN", F.lit("Fewer than five questions have no paired intervals."), n_questions=few),
        _finding(limit("latency_or_cost_limited") & costly, "warning", "SMALL_GAIN_HIGH_TOKEN_COST", _text(mark("leader"), " takes more than twice the tokens for about the same result."), leader_tokens=zero(m["tokens_used_total"]), runner_up_tokens=zero(r["tokens_used_total"])),
        _finding(limit("latency_or_cost_limited") & ~costly, "warning", "SMALL_GAIN_HIGH_LATENCY", _text(mark("leader"), " takes more than twice the time for about the same result."), leader_latency_ms_p50=zero(m["latency_ms_p50"]), runner_up_latency_ms_p50=zero(r["latency_ms_p50"])),
        _finding(limit("refusal_limited"), "warning", "HIGH_REFUSAL_RATE", _text(mark("leader"), " declines ", F.format_string("%.1f%%", 100 * m["refusal_rate"]), " of the questions."), refusal_rate=m["refusal_rate"]),
        _finding(limit("citation_limited"), "warning", "LOW_ANSWER_CITATION_QUALITY", F.lit("The right sources are found, but the answers seldom name them."), retrieval_source_recall=m["retrieval_source_recall"], answer_citation_recall=zero(m["answer_citation_recall"]), answer_citation_precision=zero(m["answer_citation_precision"])),
        _finding(limit("generation_limited"), "warning", "GENERATION_GAP", F.lit("The right sources are found, but the answers lack what they say."), retrieval_source_recall=m["retrieval_source_recall"], must_include_match=m["must_include_match"], gap=m["retrieval_source_recall"] - m["must_include_match"]),
        _finding(limit("retrieval_limited"), "warning", "LOW_RETRIEVAL_RECALL", _text("No more than ", num(m["retrieval_source_recall"]), " of the needed sources are found; 0.700 is the least."), retrieval_source_recall=m["retrieval_source_recall"]),
    )
    case = F.when(~led, "missing").when((F.col("bottleneck") == "inconclusive") & (few < 20), "underpowered").otherwise(F.col("bottleneck"))
    phrase = F.when(F.col("weakest_tier").isNotNull(), _text(" on `", F.col("weakest_tier"), "` questions")).otherwise("")
    weak = F.when(phrase != "", phrase).otherwise(" of the tiers that do worst")
    who = F.coalesce("leader", F.lit(primary))

    def said(which: int) -> Column:
        text = None
        for k, v in ADVICE.items():
            text = F.when(case == k, F.lit(v[which])) if text is None else text.when(case == k, F.lit(v[which]))
        return F.replace(F.replace(F.replace(text, F.lit("{tier_or_weak}"), weak), F.lit("{tier}"), phrase), F.lit("{}"), who)

    return row.select(F.lit(primary).alias("primary_metric"), "leader", "runner_up", "bottleneck", F.when(led, F.col("weakest_tier")).alias("weakest_tier"), said(0).alias("recommendation"), said(1).alias("next_experiment"), F.filter(found, lambda f: f.isNotNull()).alias("findings"))
