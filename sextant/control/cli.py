"""The command line: python -m sextant.control.cli GROUP COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import spans as S
from ..operators import traces as T
from ..sources import files
from ..sources import reports as V
from . import registry, report, runs
from .config import DEFAULT_POLICIES, GATES, RunSpec, load_env, load_project, load_yaml, names_of
from .retriever import ask, parse_headers, rankings

FAILED = 2  # exit code of a gate that failed


def _spark() -> SparkSession:
    s = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _say(lines: list[str]) -> int:
    for x in lines:
        print(f"FAILED {x}")
    return FAILED if lines else 0


def rag_run(a: argparse.Namespace) -> int:
    load_env(a.env)
    made = runs.run_rag(_spark(), load_yaml(a.config), a.root, a.out, systems=names_of(a.systems) or None)
    print(report.comparison_markdown(made))
    return 0


def rag_compare(a: argparse.Namespace) -> int:
    s = _spark()
    return _say([f"{f['system']}: {f['reason']}" for f in runs.compare(s, runs.load_comparison(s, a.baseline), runs.load_comparison(s, a.candidate), a.metric, a.max_drop, names_of(a.systems) or None)])


def rag_rejudge(a: argparse.Namespace) -> int:
    s = _spark()
    rows = E.rejudge(s.read.parquet(a.rows), files.read_questions(s, a.questions), E.MockJudge())
    rows.write.mode("overwrite").parquet(a.out)
    E.summary(s.read.parquet(a.out)).orderBy("system", "tier", "metric").show(200, False)
    return 0


def traces_eval(a: argparse.Namespace) -> int:
    s = _spark()
    live = (lambda q: rankings(ask(q, a.url, k=a.k, headers=parse_headers(a.header), timeout=a.timeout))) if a.url else None
    summary, table, _ = runs.run_traces(s, files.read_traces(s, a.traces), files.read_corpus(s, a.corpus) if a.corpus else None, names_of(a.policies) or list(DEFAULT_POLICIES), a.out, k=a.k, ask=live)
    print(report.trace_markdown(table))
    found = []
    if a.gate_policy:
        kept = {runs.TRACE_GATES[k]: v for k in GATES if (v := getattr(a, k)) is not None}
        found += [r.message for r in T.gate_failures(summary, a.gate_policy, **kept).collect()]
        if a.baseline:
            worse = {k: v for k, v in (("max_recall_5_drop", a.max_recall_at_5_drop), ("zero_recall", a.max_zero_recall_at_k_increase), ("stale_1", a.max_stale_at_1_increase), ("false_lead", a.max_false_lead_at_k_increase)) if v is not None}
            found += [r.message for r in T.gate_regressions(summary, V.read_trace_metrics(s, a.baseline), a.gate_policy, **worse).collect()]
    return _say(found)


def traces_normalize(a: argparse.Namespace) -> int:
    s = _spark()
    rows = S.normalise_export(files.read_export(s, a.input), source=a.source, require_question=not a.keep_all, require_gold=a.require_gold, vendor=a.vendor)
    print(files.write_traces(rows, a.output))
    return 0


def traces_from_report(a: argparse.Namespace) -> int:
    """A report's rows, or a table of them, as traces."""
    s = _spark()
    rows = V.read_report(s, a.report)["rows"] if a.report else s.read.parquet(a.rows)
    print(files.write_traces(E.bridge(rows, files.read_questions(s, a.questions)), a.output))
    return 0


def report_build(a: argparse.Namespace) -> int:
    s = _spark()
    load = lambda p: runs.load_comparison(s, p) if p else None
    c, b = load(a.report), load(a.baseline)
    policies = V.load_policies(a.traces) if a.traces else None
    flags = V.read_per_turn(s, a.turns).withColumn("at", F.monotonically_increasing_id()) if a.turns else None
    examples = [r.asDict() for r in T.failure_examples(flags, "at").orderBy("flag", "place").collect()] if a.turns else None  # three a flag
    failed = runs.compare(s, b, c, a.metric, a.max_drop) if b and c and a.metric else []
    Path(a.output).write_text(report.html_report(a.title, comparison=c, failures=failed, baseline=b, metric=a.metric, policies=policies, examples=examples), encoding="utf-8")
    return 0


def report_scorecard(a: argparse.Namespace) -> int:
    text = report.scorecard(runs.load_comparison(_spark(), a.input), a.pending or ())
    if not a.target:
        print(text, end="")
        return 0
    if not report.inject(a.target, text):
        print(f"{a.target} lacks the marks {report.BEGIN} and {report.END}", file=sys.stderr)
        return 1
    return 0


def _finished(m: registry.Manifest) -> int:
    print(f"{m.run_id} {m.status}")
    return _say(m.failures)


def runs_create(a: argparse.Namespace) -> int:
    spec = RunSpec(name=a.name, registry=a.registry, root=a.root, rag_config=a.rag_config, baseline_report=a.baseline, regression_metric=a.metric, max_drop=a.max_drop, trace_input=a.traces, corpus=a.corpus, snapshot_inputs=a.snapshot_inputs, gate_policy=a.gate_policy, gates={k: v for k in GATES if (v := getattr(a, k)) is not None})
    spec.policies = tuple(names_of(a.policies)) or spec.policies
    return _finished(runs.create_run(_spark(), spec))


def runs_list(a: argparse.Namespace) -> int:
    for m in registry.runs(a.registry):
        print("\t".join([m.run_id, m.status, m.name or "", m.created_at]))
    return 0


def project_run(a: argparse.Namespace) -> int:
    return _finished(runs.create_run(_spark(), load_project(a.config)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sextant")
    groups = top.add_subparsers(required=True)

    def command(group, name: str, run, *args: tuple) -> None:
        p = group.add_parser(name)
        p.set_defaults(run=run)
        for flag, more in args:
            p.add_argument(flag, **more)
        p.set_defaults(**{x: None for x in ("report", "rows") if run is traces_from_report and f"--{x}" not in [f for f, _ in args]})

    need, many, yes = {"required": True}, {"action": "append"}, {"action": "store_true"}
    real = lambda d=None: {"type": float, "default": d}
    gates = [(f"--{k.replace('_', '-')}", real()) for k in GATES]
    g = groups.add_parser("rag").add_subparsers(required=True)
    command(g, "run", rag_run, ("--config", need), ("--root", {"default": "."}), ("--out", need), ("--systems", {}), ("--env", {"default": ".env"}))
    command(g, "compare", rag_compare, ("--baseline", need), ("--candidate", need), ("--metric", need), ("--max-drop", real(0.02)), ("--systems", {}))
    command(g, "rejudge", rag_rejudge, ("--rows", need), ("--questions", need), ("--out", need))
    g = groups.add_parser("traces").add_subparsers(required=True)
    increases = [(f"--max-{k}-increase", real()) for k in ("zero-recall-at-k", "stale-at-1", "false-lead-at-k")]
    command(g, "eval", traces_eval, ("--traces", need), ("--corpus", {}), ("--policies", {}), ("--out", need), ("--k", {"type": int, "default": 10}), ("--url", {}), ("--header", many), ("--timeout", real(10.0)), ("--gate-policy", {}), *gates, ("--baseline", {}), ("--max-recall-at-5-drop", real()), *increases)
    command(g, "normalize", traces_normalize, ("--input", need), ("--output", need), ("--source", {"default": "auto"}), ("--keep-all", yes), ("--require-gold", yes), ("--vendor", {}))
    command(g, "from-report", traces_from_report, ("--report", need), ("--questions", need), ("--output", need))
    command(g, "from-rows", traces_from_report, ("--rows", need), ("--questions", need), ("--output", need))
    g = groups.add_parser("report").add_subparsers(required=True)
    command(g, "build", report_build, ("--report", {}), ("--baseline", {}), ("--traces", {}), ("--turns", {}), ("--metric", {}), ("--max-drop", real(0.02)), ("--title", {"default": "Evaluation"}), ("--output", need))
    command(g, "scorecard", report_scorecard, ("--input", need), ("--target", {}), ("--pending", many))
    g = groups.add_parser("runs").add_subparsers(required=True)
    command(g, "create", runs_create, ("--name", {}), ("--registry", {"default": RunSpec.registry}), ("--root", {"default": "."}), ("--rag-config", {}), ("--baseline", {}), ("--metric", {}), ("--max-drop", real(0.02)), ("--traces", {}), ("--corpus", {}), ("--policies", {}), ("--snapshot-inputs", yes), ("--gate-policy", {}), *gates)
    command(g, "list", runs_list, ("--registry", {"default": RunSpec.registry}))
    for name in ("project", "ci"):
        command(groups.add_parser(name).add_subparsers(required=True), "run", project_run, ("--config", need))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    raise SystemExit(main())
