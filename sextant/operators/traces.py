"""Trace replay: conversations to turns, turns to query texts by policy, rankings to flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cap_words, parent_id, strip

#: The names that metrics have in files and messages.
PUBLISHED = {"recall_5": "recall_at_5", "recall_k": "recall_at_k", "zero_recall": "zero_recall_at_k", "drift_1": "drift_at_1", "stale_1": "stale_at_1", "false_lead": "false_lead_at_k"}
POLICIES = ("recorded", "query_only", "current_need", "last_answer", "last_answer_x3", "compact_state", "public_trace")


def turns(conversations: DataFrame, *, answers: bool = True) -> DataFrame:
    """(session, turn, question, last, answers): user turns with the assistant's answers before them.

    Without ``answers`` only the last one is kept, which costs no more in a long conversation than in a short one.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "assistant", F.col("text"))
    rows = conversations.withColumn("last", F.last(said, ignorenulls=True).over(w))
    if answers:
        rows = rows.withColumn("answers", F.collect_list(said).over(w))
    rows = rows.where("role = 'user'")
    return rows.select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("question"), F.coalesce("last", F.lit("")).alias("last"), *(["answers"] if answers else []))


def policy_text(policy: str, question: Column, last: Column, *, recorded: Column | None = None, need: Column | None = None, known: Column | None = None, previous: Column | None = None, excluded: Column | None = None, trace: Column | None = None) -> Column:
    """The query text that a policy sends; absent state is as if empty. ``known`` are facts, ``previous`` earlier answers."""
    none = F.array().cast("array<string>")
    filled = lambda c: F.nullif(c, F.lit("")) if c is not None else F.lit(None).cast("string")
    if policy in ("recorded", "production_baseline"):
        return F.coalesce(filled(recorded), question)
    if policy == "query_only":
        return question
    if policy == "current_need":
        return F.coalesce(filled(need), question)
    if policy == "last_answer":
        return strip(F.concat_ws(" ", last, question))
    if policy == "last_answer_x3":
        return strip(F.concat_ws(" ", last, last, last, question))
    line = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    if policy == "compact_state":
        facts = F.concat(known if known is not None else none, previous if previous is not None else none)
        parts = [F.concat(F.lit("Question: "), question), line("Need: ", F.coalesce(filled(need), F.lit(""))), line("Known: ", F.array_join(facts, " | ")), line("Exclude: ", F.array_join(excluded if excluded is not None else none, " | "))]
        return cap_words(F.concat_ws("\n", *parts), 120)
    if policy == "public_trace":
        lines = F.concat(F.array(question), trace if trace is not None else none)
        return cap_words(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 500)
    raise ValueError(f"unknown policy {policy}")


def with_parents(ids: Column) -> Column:
    """Ids with the documents that they are chunks of."""
    return F.array_union(ids, F.transform(ids, parent_id))


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    """Recall among the first k, chunks and documents both counted; null without gold."""
    got, want = with_parents(F.slice(ranked, 1, k)), with_parents(gold)
    return F.try_divide(F.size(F.array_intersect(got, want)), F.size(F.array_distinct(want)))


def overlaps(ranked: Column, ids: Column, k: int) -> Column:
    return F.arrays_overlap(with_parents(F.slice(ranked, 1, k)), with_parents(ids))


def logged(ids: Column, session: Column, turn: Column, k: int = 10) -> Column:
    """The ids that production_baseline scores: those of the log; an error where there are none."""
    gone = F.raise_error(F.concat(F.lit("production_baseline needs logged ids: session "), session.cast("string"), F.lit(", turn "), turn.cast("string")))
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.slice(ids, 1, k)).otherwise(gone)


def turn_flags(ranked: DataFrame, k: int = 10, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flags of rows (policy, session, turn, ids, gold, previous, false_leads), a row each, whether or not their names repeat.

    Without gold nothing drifts and recall is null. Columns of ``keep`` come along.
    """
    none = F.array().cast("array<string>")
    c = lambda name: F.coalesce(F.col(name), none)
    ids, gold = c("ids"), c("gold")
    hit = overlaps(ids, gold, 1)
    r_k = recall_at(ids, gold, k)
    drift = (F.size(gold) > 0) & (F.size(ids) > 0) & ~hit
    stale = overlaps(ids, c("previous"), 1) & ~hit
    return ranked.select("policy", "session", "turn", recall_at(ids, gold, min(5, k)).alias("recall_5"), r_k.alias("recall_k"), F.coalesce(r_k == 0, F.lit(False)).alias("zero_recall"), drift.alias("drift_1"), stale.alias("stale_1"), overlaps(ids, c("false_leads"), k).alias("false_lead"), *keep)


def policy_summary(flags: DataFrame) -> DataFrame:
    means = [F.avg(F.col(m).cast("double")).alias(m) for m in ("recall_5", "recall_k", "zero_recall", "drift_1", "stale_1", "false_lead")]
    return flags.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), *means)


def policy_deltas(summary: DataFrame, reference: str) -> DataFrame:
    """(policy, delta): recall_5 less that of the reference policy; none where either is null."""
    base = F.broadcast(summary.where(F.col("policy") == reference).select(F.col("recall_5").alias("_base")))  # one row
    return summary.crossJoin(base).select("policy", (F.col("recall_5") - F.col("_base")).alias("delta")).where("delta is not null")


def policy_order(summary: DataFrame) -> DataFrame:
    """Add place: recall_5 falling (none comes first), zero_recall rising, name."""
    order = Window.orderBy(F.col("recall_5").desc_nulls_first(), F.col("zero_recall").asc_nulls_last(), "policy")  # a row for each policy
    return summary.withColumn("place", F.row_number().over(order).cast("long"))


def best_policy(summary: DataFrame) -> DataFrame:
    """One row (policy): the highest recall_5, the first by name among equals."""
    return summary.where("recall_5 is not null").orderBy(F.desc("recall_5"), "policy").limit(1).select("policy")


MESSAGE = "metric string, value double, bound double, message string"


def _absent(spark, summary: DataFrame, policy: str, message: str) -> DataFrame:
    """One row with the message if the summary lacks the policy: a gate that can't be computed fails."""
    one = spark.range(1).select(F.lit(policy).alias("policy"))
    missing = one.join(summary.select("policy"), "policy", "left_anti")
    return missing.select(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("bound"), F.lit(message).alias("message"))


def _published(metric: str) -> Column:
    return F.lit(PUBLISHED.get(metric, metric))


def _number(c: Column, sign: str = "") -> Column:
    return F.format_string(f"%{sign}.3f", c)


def gate_failures(summary: DataFrame, policy: str, *, min_recall_5: float | None = None, **most: float) -> DataFrame:
    """(metric, value, bound, message) of thresholds that a policy misses, metrics by their published names.

    A policy that was not evaluated fails with a row of its own; a value that can't be computed (recall, where no turn has gold)
    passes. Files that lack a metric don't come this far: reading them is an error.
    """
    absent = _absent(summary.sparkSession, summary, policy, f"policy `{policy}` was not evaluated")
    rules = ([("recall_5", min_recall_5, 1.0)] if min_recall_5 is not None else []) + [(m, b, -1.0) for m, b in most.items() if b is not None]
    if not rules:
        return absent
    own = summary.where(F.col("policy") == policy)
    checks = F.explode(F.array(*[F.struct(_published(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("bound"), F.lit(s).alias("sign")) for m, b, s in rules]))
    failed = own.select(checks.alias("c")).select("c.*").where("value * sign < bound * sign")
    message = F.concat(F.lit(f"{policy}."), "metric", F.lit("="), _number(F.col("value")), F.when(F.col("sign") > 0, " violates >= ").otherwise(" violates <= "), _number(F.col("bound")))
    return failed.withColumn("message", message).drop("sign").unionByName(absent)


def gate_regressions(summary: DataFrame, baseline: DataFrame, policy: str, *, max_recall_5_drop: float | None = None, **increase: float) -> DataFrame:
    """(metric, value, bound, message): by how much a policy got worse than its baseline, where that is more than allowed."""
    spark = summary.sparkSession
    absent = _absent(spark, summary, policy, f"policy `{policy}` was not evaluated")
    unknown = _absent(spark, baseline, policy, f"policy `{policy}` is missing from baseline metrics").join(F.broadcast(summary.where(F.col("policy") == policy).select("policy")), how="left_semi")
    rules = ([("recall_5", max_recall_5_drop, -1.0)] if max_recall_5_drop is not None else []) + [(m, b, 1.0) for m, b in increase.items() if b is not None]
    found = absent.unionByName(unknown)
    if not rules:
        return found
    metrics = [m for m, _, _ in rules]
    now = summary.where(F.col("policy") == policy).select(*[F.col(m).cast("double").alias(f"n_{m}") for m in metrics])
    then = baseline.where(F.col("policy") == policy).select(*[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    checks = F.explode(F.array(*[F.struct(_published(m).alias("metric"), (F.col(f"n_{m}") - F.col(f"b_{m}")).alias("value"), F.lit(float(b)).alias("bound"), F.lit(s).alias("sign")) for m, b, s in rules]))
    worse = now.crossJoin(F.broadcast(then)).select(checks.alias("c")).select("c.*").where("value * sign > bound")  # one row each
    drop = F.concat(F.lit(f"{policy}."), "metric", F.lit(" delta="), _number(F.col("value")), F.lit(" drops more than "), _number(F.col("bound")))
    rise = F.concat(F.lit(f"{policy}."), "metric", F.lit(" delta="), _number(F.col("value"), "+"), F.lit(" increases more than "), _number(F.col("bound")))
    return found.unionByName(worse.withColumn("message", F.when(F.col("sign") < 0, drop).otherwise(rise)).drop("sign"))


def failure_examples(flags: DataFrame, *order: str, limit: int = 3) -> DataFrame:
    """(flag, policy, session, turn, place): the first ``limit`` rows in order that have each flag, a turn and policy once."""
    names = ["zero_recall", "drift_1", "stale_1", "false_lead"]
    long = flags.select(*order, "policy", "session", "turn", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in names])).alias("x")).where("x.on")
    once = long.groupBy(F.col("x.flag").alias("flag"), "policy", "session", "turn").agg(F.min(F.struct(*order)).alias("ord"))
    w = Window.partitionBy("flag").orderBy("ord")
    return once.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit).drop("ord")
