"""Reports and metrics as files: what is written here is read here, and is the form that users' files have.

A comparison report is one JSON document: systems, n_questions, n_per_tier, by_system_metric, by_system_tier_metric, pairwise, and a row for every
question and system. Metrics of a replay are one JSON document: policies, and their recall against two reference policies. A replay's
turns are JSON lines. Names in files are ``PUBLISHED``; frames use the short ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traces import PUBLISHED

CITED = "ARRAY<STRUCT<source_path: STRING, span: STRING>>"
ANSWER = f"STRUCT<answer: STRING, citations: {CITED}, latency_ms: DOUBLE, tokens_used: BIGINT, refused: BOOLEAN, refusal_reason: STRING, retrieved_sources: {CITED}, answer_citations: {CITED}, retrieval_latency_ms: DOUBLE>"
MEASURES = ("must_include_match", "must_not_include_violations", "answer_citation_precision", "answer_citation_recall", "retrieval_source_precision", "retrieval_source_recall", "faithfulness", "relevance", "abstention_correctness", "answer_length_chars")
ROW = f"STRUCT<system: STRING, question_id: STRING, tier: STRING, answer: {ANSWER}, {', '.join(f'{m}: ' + ('BIGINT' if m in ('must_not_include_violations', 'answer_length_chars') else 'DOUBLE') for m in MEASURES)}, refused: BOOLEAN>"
PAIR = "STRUCT<metric: STRING, system_a: STRING, system_b: STRING, mean_a: DOUBLE, mean_b: DOUBLE, mean_diff: DOUBLE, ci_low: DOUBLE, ci_high: DOUBLE, alpha: DOUBLE, n: BIGINT, significant: BOOLEAN>"
REPORT = f"systems ARRAY<STRING>, n_questions BIGINT, n_per_tier MAP<STRING,BIGINT>, by_system_metric MAP<STRING,MAP<STRING,DOUBLE>>, by_system_tier_metric MAP<STRING,MAP<STRING,MAP<STRING,DOUBLE>>>, rows ARRAY<{ROW}>, pairwise ARRAY<{PAIR}>"
PER_TURN = "session_id STRING, turn_id STRING, policy STRING, query_text STRING, ranked_ids ARRAY<STRING>, gold_ids ARRAY<STRING>, recall_at_5 DOUBLE, recall_at_k DOUBLE, zero_recall_at_k BOOLEAN, drift_at_1 BOOLEAN, stale_at_1 BOOLEAN, false_lead_at_k BOOLEAN"


class ReportError(ValueError):
    """A file lacks what a report or a metrics file must have."""


def report_rows(rows: DataFrame) -> DataFrame:
    """Rows of an evaluation in the form that a report has."""
    cited = lambda c: F.coalesce(F.col(c), F.array().cast(CITED)).cast(CITED)
    answer = F.struct(
        F.coalesce("answer", F.lit("")).alias("answer"), cited("citations").alias("citations"), F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)).alias("latency_ms"), F.coalesce(F.col("tokens_used").cast("long"), F.lit(0)).alias("tokens_used"),
        "refused", "refusal_reason", cited("retrieved_sources").alias("retrieved_sources"), cited("answer_citations").alias("answer_citations"), F.col("retrieval_latency_ms").cast("double").alias("retrieval_latency_ms"),
    )
    whole = {"must_not_include_violations": F.col("must_not_include_violations").cast("long"), "answer_length_chars": F.coalesce(F.col("answer_length_chars").cast("long"), F.lit(0))}
    return rows.select("system", F.col("qid").alias("question_id"), "tier", answer.alias("answer"), *[whole.get(m, F.col(m).cast("double")).alias(m) for m in MEASURES], "refused")


def write_report(path: str | Path, made: dict[str, Any], rows: DataFrame, order: Iterable[str] = ()) -> int:
    """Write a comparison (see control.report) with all its rows, in ``order``; the number of rows.

    The document is one file by its form. Its rows pass through the driver one partition at a time and are not held there; next to
    it a run keeps them as a table.
    """
    head = {"systems": list(made["systems"]), "n_questions": made["n_questions"], "n_per_tier": made["n_per_tier"], "by_system_metric": made["metrics"], "by_system_tier_metric": made["tier_metrics"], "pairwise": made["pairwise"]}
    own = rows.orderBy(*order) if order else rows
    lines = report_rows(own).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    n = 0
    with Path(path).open("w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "rows": [')
        for r in lines.toLocalIterator():
            f.write(("," if n else "") + "\n" + r.line)
            n += 1
        f.write("]}\n")
    return n


def read_report(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """A report's rows (with ``at``, their place), summary, tiers, pairwise and header (systems, n_questions) as frames."""
    r = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(str(path))
    rows = r.select(F.posexplode("rows").alias("at", "x")).select("at", "x.*").withColumnRenamed("question_id", "qid")
    flat = rows.select(*[c for c in rows.columns if c != "answer"], *[F.col(f"answer.{c}").alias(c) for c in ("answer", "citations", "latency_ms", "tokens_used", "refusal_reason", "retrieved_sources", "answer_citations", "retrieval_latency_ms")])
    whole = r.select(F.explode("by_system_metric").alias("system", "m")).select("system", F.lit(None).cast("string").alias("tier"), F.explode("m").alias("metric", "value"))
    tiers = r.select(F.explode("by_system_tier_metric").alias("system", "t")).select("system", F.explode("t").alias("tier", "m")).select("system", "tier", F.explode("m").alias("metric", "value"))
    return {"header": r.select("systems", "n_questions"), "rows": flat, "summary": whole.unionByName(tiers), "tiers": r.select(F.explode("n_per_tier").alias("tier", "n")), "pairwise": r.select(F.explode("pairwise").alias("p")).select("p.*")}


def metrics_document(policies: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """Metrics of a replay as they are written: published names, NaN for what can't be computed."""
    value = lambda v: math.nan if v is None else float(v)
    out: dict[str, Any] = {"policies": {p: {"n": int(m["n"])} | {name: value(m.get(c)) for c, name in PUBLISHED.items()} for p, m in sorted(policies.items())}}
    for reference in ("recorded", "query_only"):
        base = out["policies"].get(reference, {}).get("recall_at_5")
        if base is not None:
            out[f"policy_deltas_vs_{reference}_recall_at_5"] = {p: m["recall_at_5"] - base for p, m in out["policies"].items() if not math.isnan(m["recall_at_5"] - base)}
    return out


def parse_metrics(document: dict[str, Any], path: str = "metrics") -> dict[str, dict[str, Any]]:
    """{policy: {n, recall_5, ...}} of a metrics document, None for NaN; a policy without one of the metrics is an error."""
    if not isinstance(document, dict) or not isinstance(document.get("policies"), dict):
        raise ReportError(f"{path} has no policies")
    out = {}
    for p, m in document["policies"].items():
        if gone := [name for name in ("n", *PUBLISHED.values()) if not isinstance(m, dict) or not isinstance(m.get(name), int | float)]:
            raise ReportError(f"{path}: policy `{p}` lacks {', '.join(gone)}")
        out[p] = {"n": int(m["n"])} | {c: None if math.isnan(m[name]) else float(m[name]) for c, name in PUBLISHED.items()}
    return out


def write_trace_metrics(path: str | Path, policies: dict[str, dict[str, Any]]) -> None:
    Path(path).write_text(json.dumps(metrics_document(policies), indent=2), encoding="utf-8")


def load_policies(path: str | Path) -> dict[str, dict[str, Any]]:
    """The policies of a metrics file."""
    return parse_metrics(json.loads(Path(path).read_text(encoding="utf-8")), str(path))


def read_trace_metrics(spark: SparkSession, path: str | Path) -> DataFrame:
    """(policy, n, recall_5, ...) of a metrics file: a row for each policy. A file without a metric is an error, so that no gate passes for it."""
    return policy_frame(spark, load_policies(path))


def policy_frame(spark: SparkSession, policies: dict[str, dict[str, Any]]) -> DataFrame:
    schema = "policy string, n long, " + ", ".join(f"{c} double" for c in PUBLISHED)
    return spark.createDataFrame([(p, m["n"], *(None if m.get(c) is None else float(m[c]) for c in PUBLISHED)) for p, m in sorted(policies.items())], schema)


def turn_rows(flags: DataFrame) -> DataFrame:
    """Flags of turns (with query, ids, gold) as they are written; a recall that can't be computed is NaN."""
    nan = F.lit(float("nan"))
    own = {c: F.coalesce(F.col(c), nan) if c in ("recall_5", "recall_k") else F.col(c) for c in PUBLISHED}
    none = F.array().cast("array<string>")
    return flags.select(F.col("session").alias("session_id"), F.col("turn").alias("turn_id"), "policy", F.col("query").alias("query_text"), F.coalesce("ids", none).alias("ranked_ids"), F.coalesce("gold", none).alias("gold_ids"), *[v.alias(PUBLISHED[c]) for c, v in own.items()])


def read_per_turn(spark: SparkSession, path: str | Path) -> DataFrame:
    """(policy, session, turn, query, ids, gold, recall_5, ...) of the turns of a replay: a JSON-lines file, or a folder of them."""
    rows = spark.read.schema(PER_TURN).option("mode", "FAILFAST").json(str(path))
    own = {c: F.when(~F.isnan(name), F.col(name)) if c in ("recall_5", "recall_k") else F.col(name) for c, name in PUBLISHED.items()}
    return rows.select("policy", F.col("session_id").alias("session"), F.col("turn_id").alias("turn"), F.col("query_text").alias("query"), F.col("ranked_ids").alias("ids"), F.col("gold_ids").alias("gold"), *[v.alias(c) for c, v in own.items()])
