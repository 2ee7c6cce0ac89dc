"""Evaluations end to end: from files to frames, reports, gates and a manifest."""

from __future__ import annotations

import json
import shutil
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import paragraph_chunks
from ..operators import diagnosis as D
from ..operators import evaluation as E
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import spans as S
from ..operators import traces as T
from ..sources import files
from ..sources import reports as V
from ..sources.cache import TextCache
from . import registry as G
from . import report as P
from . import retriever as H
from . import systems as Y
from .config import ConfigError, RunSpec, load_yaml, names_of, options_of, pick

TRACE_GATES = {"min_recall_at_5": "min_recall_5", "max_zero_recall_at_k": "zero_recall", "max_stale_at_1": "stale_1", "max_false_lead_at_k": "false_lead"}


def chunks_of(docs: DataFrame, *, separator: str = r"\n\s*\n", limit: int | None = None) -> DataFrame:
    """(doc, ord, source_path, text) of documents (source_path, text, doc_ord); the first ``limit`` in corpus order."""
    c = docs.select("source_path", "doc_ord", F.posexplode(paragraph_chunks(F.col("text"), separator)).alias("chunk_index", "text"))
    c = c.select(F.concat("source_path", F.lit("#chunk-"), F.col("chunk_index").cast("string")).alias("doc"), F.struct("doc_ord", "chunk_index").alias("ord"), "source_path", "chunk_index", "text")
    return c.orderBy("ord").limit(limit) if limit else c


def run_rag(spark: SparkSession, config: dict[str, Any], root: str | Path, out: str | Path, *, systems: list[str] | None = None, models: Y.Models | None = None, judge=None, more: dict[str, Y.System] | None = None) -> dict[str, Any]:
    """Evaluate a config's systems on its questions; report.json, report.md, diagnosis.json and rows under ``out``. Returns the comparison.

    Keys: corpus (globs), questions, systems, top_k, separator, max_chunks, judge, primary_metric, cache (a folder for what models say
    about chunks). ``models`` stand in for the mock ones, ``judge`` for the config's, and ``more`` adds systems by name. What models and
    systems give is written under ``out`` before it is used.
    """
    base, known = Path(root), Y.SYSTEMS | (more or {})
    globs, questions_at = names_of(pick(None, config, "corpus")), pick(None, config, "questions")
    if not globs or not questions_at:
        raise ConfigError("corpus and questions are required")
    names = systems or names_of(pick(None, config, "systems")) or ["bm25", "dense", "hybrid"]
    if bad := [n for n in names if n not in known]:
        raise ConfigError(f"unknown systems: {', '.join(bad)}")
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    work = folder / "work"
    shutil.rmtree(work, ignore_errors=True)
    cache = pick(None, config, "cache")
    cx = Y.Context(models or Y.Models(), int(pick(None, config, "top_k", 5)), str(work), TextCache(spark, str(base / cache)) if cache else None)
    docs = files.read_documents(spark, globs, base.resolve().as_posix())
    chunks = cx.keep(chunks_of(docs, separator=pick(None, config, "separator", r"\n\s*\n"), limit=pick(None, config, "max_chunks")))
    questions = cx.keep(files.read_questions(spark, str(base / questions_at)))
    answers = {n: cx.keep(known[n](chunks, questions, cx)) for n in names}
    judge = judge or {"none": None, "mock": E.MockJudge()}[pick(None, config, "judge", "mock")]
    rows_at = str(folder / "rows")

    def keep(rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(rows_at)
        return spark.read.schema(rows.schema).parquet(rows_at)

    got = E.run_eval(spark, questions, answers, judge, keep=keep)
    n_questions, primary = questions.count(), pick(None, config, "primary_metric", "must_include_match")
    diagnosis = D.diagnose(got["summary"], got["pairwise"], names, n_questions, primary=primary)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = got["rows"].join(R.small(questions.select(F.col("id").alias("qid"), F.col("ord").alias("_q"))), "qid").withColumn("at", F.struct("_q", F.try_element_at(place, F.col("system")))).drop("_q")
    made = P.gather(names, n_questions, got["summary"], got["tiers"], got["pairwise"], diagnosis, rows)
    V.write_report(folder / "report.json", made, rows, ["at"])
    (folder / "diagnosis.json").write_text(json.dumps(made["diagnosis"], indent=2, default=str), encoding="utf-8")
    (folder / "report.md").write_text(P.comparison_markdown(made), encoding="utf-8")
    shutil.rmtree(work, ignore_errors=True)
    return made


def replay(traces: DataFrame, corpus: DataFrame | None, policies: list[str], k: int = 10, ask=None) -> DataFrame:
    """(policy, session, turn, ids, gold, previous, false_leads, ord) of trace records replayed with each policy.

    ``corpus`` is (chunk_id, text, ord); ``ask(queries: key, query) -> (key, rank, id)`` stands in for it. A policy other than
    production_baseline needs one of them.
    """
    if bad := [p for p in policies if p not in (*T.POLICIES, "production_baseline")]:
        raise ConfigError(f"unknown policies: {', '.join(bad)}")
    live = [p for p in policies if p != "production_baseline"]
    if live and corpus is None and ask is None:
        raise ConfigError(f"a corpus or a retriever is needed for: {', '.join(live)}")
    last = F.coalesce(F.try_element_at("previous_answers", F.lit(-1)), F.lit(""))
    c = F.col
    text = lambda p: T.policy_text(p, c("user_question"), last, recorded=c("retrieval_query"), need=c("current_need"), known=c("known_facts"), previous=c("previous_answers"), excluded=c("excluded_leads"), trace=c("public_trace"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), text(p).alias("query"), F.lit(i).alias("at")) for i, p in enumerate(policies)]))
    rows = traces.select("ord", "session_id", "turn_id", "retrieved_ids", "gold_ids", "previous_doc_ids", "false_lead_doc_ids", each.alias("x")).select("*", "x.*").drop("x").withColumn("key", F.to_json(F.struct("ord", "policy")))
    found = None
    asks = rows.where("policy <> 'production_baseline'")
    if live:
        if ask is not None:
            ranked = ask(asks.select("key", "query")).select("key", "rank", "id")
        else:
            ranked = R.bm25_rank(corpus.select(F.col("chunk_id").alias("doc"), "ord", "text"), asks.select(F.col("key").alias("qid"), "query"), k, late_first=False).select(F.col("qid").alias("key"), "rank", F.col("doc").alias("id"))
            blank = asks.where(~F.col("query").rlike("[A-Za-z0-9_]")).select("key")
            ranked = ranked.join(blank, "key", "left_anti")  # a query without a word finds nothing
        found = ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))
    none = F.array().cast("array<string>")
    joined = rows.join(found, "key", "left") if found is not None else rows.withColumn("found", none)
    ids = F.when(F.col("policy") == "production_baseline", T.logged(F.col("retrieved_ids"), F.col("session_id"), F.col("turn_id"), k)).otherwise(F.coalesce("found", none))
    return joined.select("policy", F.col("session_id").alias("session"), F.col("turn_id").alias("turn"), ids.alias("ids"), F.col("gold_ids").alias("gold"), F.col("previous_doc_ids").alias("previous"), F.col("false_lead_doc_ids").alias("false_leads"), F.struct("ord", "at").alias("ord"), "query")


def run_traces(spark: SparkSession, traces: DataFrame, corpus: DataFrame | None, policies: list[str], out: str | Path, *, k: int = 10, ask=None) -> tuple[DataFrame, dict[str, Any], list[dict[str, Any]]]:
    """Replay; per_turn (JSON lines), metrics.json and report.md under ``out``. Returns (summary, policies, examples).

    Each record is scored once for each policy, whatever its ids: blank and repeated ones are records too.
    """
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    turns_at = str(folder / "turns")
    ranked = replay(traces, corpus, policies, k, ask)
    ranked.write.mode("overwrite").parquet(turns_at)  # a retriever is asked once
    flags = T.turn_flags(spark.read.schema(ranked.schema).parquet(turns_at), k, keep=("ord", "query", "ids", "gold"))
    table = {r.policy: {m: r[m] for m in P.TRACE} for r in T.policy_summary(flags).collect()}  # a row for each policy
    summary = V.policy_frame(spark, table)
    examples = [r.asDict() for r in T.failure_examples(flags, "ord").orderBy("flag", "place").collect()]  # three a flag
    V.turn_rows(flags.orderBy("ord")).write.mode("overwrite").option("ignoreNullFields", "false").json(str(folder / "per_turn"))
    V.write_trace_metrics(folder / "metrics.json", table)
    (folder / "report.md").write_text(P.trace_markdown(table, examples), encoding="utf-8")
    shutil.rmtree(turns_at, ignore_errors=True)
    return summary, table, examples


def load_comparison(spark: SparkSession, path: str | Path, worst: int = 12) -> dict[str, Any]:
    """A report file as a comparison for the reports, with its riskiest rows."""
    found = V.read_report(spark, path)
    head = found["header"].first()
    if head is None or not head.systems:
        raise V.ReportError(f"{path} is no comparison report")
    diagnosis = None
    beside = Path(path).with_name("diagnosis.json")
    if beside.is_file():
        diagnosis = json.loads(beside.read_text(encoding="utf-8"))
    return P.gather(list(head.systems), head.n_questions, found["summary"], found["tiers"], found["pairwise"], None, found["rows"], worst) | {"diagnosis": diagnosis}


def compare(spark: SparkSession, baseline: dict[str, Any], candidate: dict[str, Any], metric: str, max_drop: float, systems: list[str] | None = None) -> list[dict[str, Any]]:
    """Failures of a candidate's comparison against a baseline's."""
    side = lambda c: spark.createDataFrame([(s, c["metrics"].get(s, {}).get(metric)) for s in c["systems"]], "system string, value double")
    return [r.asDict() for r in M.regression(side(baseline), side(candidate), max_drop, systems).orderBy("system").collect()]


def create_run(spark: SparkSession, spec: RunSpec) -> G.Manifest:
    """Do what a spec says in a new run folder. The manifest is written in any case; an exception is one of its failures."""
    run_id, folder = G.reserve(spec.registry, spec.name)
    m = G.Manifest(run_id, datetime.now(UTC).isoformat(timespec="seconds"), "passed", spec.name, options=options_of(spec))
    at = lambda p: p if Path(p).is_absolute() else str(Path(spec.root) / p)
    comparison = baseline = table = examples = None
    failed: list[dict[str, Any]] = []
    try:
        m.summaries["commit"] = G.commit_of(spec.root)
        for name, path in (("rag_config", spec.rag_config), ("baseline_report", spec.baseline_report), ("trace_input", spec.trace_input), ("trace_source", spec.trace_source), ("corpus", spec.corpus)):
            if path:
                m.inputs[name], m.digests[name] = path, G.digest(at(path))
                if spec.snapshot_inputs:
                    (folder / "inputs").mkdir(exist_ok=True)
                    shutil.copy(at(path), folder / "inputs" / f"{name}{Path(path).suffix}")
        if spec.rag_config:
            comparison = run_rag(spark, load_yaml(at(spec.rag_config)) | {"primary_metric": spec.primary_metric}, spec.root, folder / "rag")
            m.artifacts["rag_report"], m.summaries["leader"] = "rag/report.json", comparison["diagnosis"]["leader"]
            if spec.baseline_report:
                baseline = load_comparison(spark, at(spec.baseline_report))
                failed = compare(spark, baseline, comparison, spec.regression_metric or spec.primary_metric, spec.max_drop)
                m.failures += [f"{f['system']}: {f['reason']}" for f in failed]
        if spec.trace_input or spec.trace_source:
            if spec.trace_source:
                rows = S.normalise_export(files.read_export(spark, at(spec.trace_source)), source=spec.trace_format, require_gold=spec.require_gold)
                files.write_traces(rows, str(folder / "traces"))
                traces = files.read_traces(spark, str(folder / "traces"))
                m.artifacts["traces"] = "traces"
            else:
                traces = files.read_traces(spark, at(spec.trace_input))
            corpus = files.read_corpus(spark, at(spec.corpus)) if spec.corpus else None
            ask, logs = None, []
            if spec.retriever_url:

                def ask(queries: DataFrame) -> DataFrame:
                    calls = H.ask(queries, spec.retriever_url, k=spec.k, headers=H.parse_headers(list(spec.retriever_headers)), timeout=spec.retriever_timeout)
                    calls.write.mode("overwrite").parquet(str(folder / "responses"))  # posted once, whatever is lost later
                    calls = spark.read.schema(calls.schema).parquet(str(folder / "responses"))
                    logs.append(calls)
                    return H.rankings(calls)

            summary, table, examples = run_traces(spark, traces, corpus, list(spec.policies), folder / "traces_eval", k=spec.k, ask=ask)
            m.artifacts["trace_metrics"] = "traces_eval/metrics.json"
            for calls in logs:
                H.call_log(calls).write.mode("overwrite").json(str(folder / "calls"))
                m.artifacts["calls"] = "calls"
                shutil.rmtree(folder / "responses", ignore_errors=True)  # the log has no texts
            if spec.gate_policy:
                kept = {TRACE_GATES[k]: v for k, v in spec.gates.items()}
                m.failures += [r.message for r in T.gate_failures(summary, spec.gate_policy, **kept).collect()]
        page = P.html_report(spec.name or run_id, comparison=comparison, failures=failed, baseline=baseline, metric=spec.regression_metric or spec.primary_metric, policies=table, examples=examples)
        (folder / "report.html").write_text(page, encoding="utf-8")
        m.artifacts["html"] = "report.html"
        m.status = "failed" if m.failures else "passed"
    except Exception as e:
        m.status = "error"
        m.failures.append(f"{type(e).__name__}: {P.short(e, 400)}")
        raise
    finally:
        G.write(folder, m)
    return m
