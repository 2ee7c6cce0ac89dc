"""Files of reports, metrics and traces in the form that users have, both ways; gates that fail closed; systems over models."""

import json
import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_control import QUESTIONS, root  # noqa: F401  (a fixture)

from sextant.control import cli, config, report, runs
from sextant.control import models as Mo
from sextant.control import systems as Y
from sextant.operators import evaluation as E
from sextant.operators import traces as T
from sextant.sources import files
from sextant.sources import reports as V

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests
METRICS = {"n": 2, "recall_at_5": 0.9, "recall_at_k": 1.0, "zero_recall_at_k": 0.0, "drift_at_1": 0.1, "stale_at_1": 0.0, "false_lead_at_k": math.nan}
TOP = {"systems", "n_questions", "n_per_tier", "rows", "by_system_metric", "by_system_tier_metric", "pairwise"}
ROW = {"system", "question_id", "tier", "answer", *V.MEASURES, "refused"}


def user_report(**recall):
    """A report as a user has it, with a recall for each system."""
    answer = {"answer": "a [doc:docs/pay.md#chunk-0]", "citations": [{"source_path": "docs/pay.md", "span": None}, {"source_path": "", "span": "x"}], "latency_ms": 1.5, "tokens_used": 3, "refused": False, "refusal_reason": None, "retrieved_sources": [], "answer_citations": [], "cost_usd": None, "meta": {"x": 1}, "retrieval_latency_ms": None}
    rows = [{"system": s, "question_id": f"q{i}", "tier": "single_hop", "answer": answer, "must_include_match": 0.5, "retrieval_source_recall": r, "answer_length_chars": 27, "refused": False} for i in (0, 1, 9) for s, r in recall.items()]
    return {"systems": list(recall), "n_questions": 3, "n_per_tier": {"single_hop": 3, "multi_hop": 0, "contradiction": 0}, "rows": rows, "by_system_metric": {s: {"retrieval_source_recall": r, "retrieval_source_precision": 0.5} for s, r in recall.items() if r is not None}, "by_system_tier_metric": {}, "pairwise": []}


def put(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_metrics_both_ways(spark, tmp_path):
    at = put(tmp_path / "m.json", {"policies": {"recorded": METRICS}, "policy_deltas_vs_recorded_recall_at_5": {"recorded": 0.0}})
    row = V.read_trace_metrics(spark, at).first()
    assert (row.policy, row.n, row.recall_5, row.stale_1, row.false_lead) == ("recorded", 2, 0.9, 0.0, None)
    V.write_trace_metrics(tmp_path / "again.json", V.load_policies(at) | {"query_only": {"n": 1} | dict.fromkeys(T.PUBLISHED, 0.25)})
    again = json.loads((tmp_path / "again.json").read_text())
    assert again["policies"]["recorded"].keys() == METRICS.keys() and math.isnan(again["policies"]["recorded"]["false_lead_at_k"])
    assert again["policy_deltas_vs_recorded_recall_at_5"] == {"query_only": -0.65, "recorded": 0.0} and again["policy_deltas_vs_query_only_recall_at_5"]["recorded"] == 0.65
    for bad in ({}, [], {"policies": []}, {"policies": {"p": {"n": 1, "recall_5": 0.9}}}, {"policies": {"p": METRICS | {"stale_at_1": None}}}):
        with pytest.raises(V.ReportError):
            V.load_policies(put(tmp_path / "bad.json", bad))


def test_gate_against_a_users_baseline(spark, root, capsys):  # noqa: F811
    """Recall of 0.9 in a baseline file against less now: the gate fails; a baseline without the metric is an error."""
    args = ["traces", "eval", "--traces", str(root / "t.jsonl"), "--corpus", str(root / "c.jsonl"), "--policies", "production_baseline", "--out", str(root / "out"), "--gate-policy", "production_baseline", "--max-recall-at-5-drop", "0.1"]
    good = put(root / "good.json", {"policies": {"production_baseline": METRICS}})
    assert cli.main([*args, "--baseline", good]) == 2 and "production_baseline.recall_at_5 delta=-0.400 drops more than 0.100" in capsys.readouterr().out
    assert cli.main([*args, "--baseline", str(root / "out" / "metrics.json")]) == 0  # what it wrote itself
    gone = put(root / "gone.json", {"policies": {"production_baseline": {k: v for k, v in METRICS.items() if k != "recall_at_5"}}})
    with pytest.raises(V.ReportError, match="lacks recall_at_5"):
        cli.main([*args, "--baseline", gone])
    other = put(root / "other.json", {"policies": {"recorded": METRICS}})
    assert cli.main([*args, "--baseline", other]) == 2
    turns = V.read_per_turn(spark, root / "out" / "per_turn").orderBy("turn").collect()
    assert [(r.policy, r.session, r.turn, r.recall_5, r.zero_recall) for r in turns] == [("production_baseline", "s", "0", 1.0, False), ("production_baseline", "s", "1", 0.0, True)]


def test_every_record_counts_once(spark, tmp_path):
    """Blank, null and repeated ids are records of their own."""
    rows = [{"user_question": "x", "retrieved_doc_ids": ["a"], "gold_doc_ids": [g]} for g in "aab"] + [{"session_id": "s", "turn_id": 1, "user_question": "x", "retrieved_doc_ids": ["a"], "gold_doc_ids": [g]} for g in "ab"] + [{"session_id": "", "turn_id": "", "user_question": "x", "retrieved_doc_ids": ["a"]}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    _, table, _ = runs.run_traces(spark, files.read_traces(spark, str(tmp_path / "t.jsonl")), None, ["production_baseline"], tmp_path / "out")
    assert table["production_baseline"]["n"] == 6 and table["production_baseline"]["recall_5"] == pytest.approx(3 / 5)
    lines = [json.loads(x) for p in (tmp_path / "out" / "per_turn").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 6 and set(lines[0]) == {x.split()[0] for x in V.PER_TURN.replace("ARRAY<", "ARRAY_").split(", ")}
    assert V.read_per_turn(spark, tmp_path / "out" / "per_turn").where("recall_5 is null").count() == 1


def test_reports_of_users(spark, root, capsys):  # noqa: F811
    base, now = put(root / "base.json", user_report(a=0.9, b=0.5)), put(root / "now.json", user_report(a=0.5, b=0.5, c=None))
    assert cli.main(["rag", "compare", "--baseline", base, "--candidate", now, "--metric", "retrieval_source_recall"]) == 2
    assert capsys.readouterr().out == "FAILED a: metric dropped beyond threshold\n"
    assert cli.main(["rag", "compare", "--baseline", base, "--candidate", now, "--metric", "faithfulness", "--systems", "a,c"]) == 2
    assert "a: missing metric in baseline report" in capsys.readouterr().out
    made = runs.load_comparison(spark, now)
    assert [(r["system"], r["qid"]) for r in made["rows"][:3]] == [("a", "q0"), ("b", "q0"), ("a", "q1")] and len(made["rows"]) == 9  # equal risks stand in the report's order
    assert cli.main(["traces", "from-report", "--report", now, "--questions", str(root / "q.jsonl"), "--output", str(root / "bridged")]) == 0
    assert capsys.readouterr().out == "6\n"  # the unknown question is left out
    back = files.read_traces(spark, str(root / "bridged")).where("session_id = 'q0' and turn_id = 'a'").first()
    assert back.retrieved_ids == ["docs/pay.md"] and back.gold_ids == ["docs/pay.md"] and back.user_question == QUESTIONS[0]["question"]
    metrics = put(root / "metrics.json", {"policies": {"recorded": METRICS}})
    assert cli.main(["report", "build", "--report", now, "--baseline", base, "--metric", "retrieval_source_recall", "--traces", metrics, "--output", str(root / "r.html")]) == 0
    page = (root / "r.html").read_text()
    assert "Regression of retrieval_source_recall" in page and "metric dropped beyond threshold" in page and "<h2>Policies</h2>" in page
    (root / "card.md").write_text(f"{report.BEGIN}{report.END}")
    assert cli.main(["report", "scorecard", "--input", now, "--target", str(root / "card.md")]) == 0 and "| c | pending" in (root / "card.md").read_text()
    with pytest.raises(Exception, match="no comparison report|MALFORMED|malformed"):
        runs.load_comparison(spark, put(root / "odd.json", {"policies": {}}))


class Loud:
    """A model that says one thing."""

    dim = 2

    def embed_batch(self, texts):
        return [[1.0, float(len(t))] for t in texts]

    def generate_batch(self, prompts):
        return [("loud answer about nightly hour [doc:docs/pay.md#chunk-0]", 7) for _ in prompts]


def always(chunks, questions, cx):
    """A user's own system."""
    ranked = questions.select(F.col("id").alias("qid"), F.lit(1).alias("rank")).crossJoin(chunks.orderBy("ord").limit(1).select(F.col("doc").alias("chunk_id"), "source_path", "text"))
    return E.answers_of("always", questions, ranked, cx.models.generate)


def test_a_report_of_every_system(spark, root):  # noqa: F811
    (root / "docs" / "facts.md").write_text("payments | settle | nightly\n\n- tokens | expire | after one hour\npayments | use | tokens")
    names = ["bm25", "dense", "hybrid", "termpad", "rerank", "chunk_summary", "claims", "pages", "always"]
    made = runs.run_rag(spark, {"corpus": ["docs/*.md"], "questions": "q.jsonl", "systems": names, "cache": "said"}, root, root / "out", models=Y.Models(generate=Mo.generator(Loud), name="loud"), more={"always": always})
    document = json.loads((root / "out" / "report.json").read_text())
    assert set(document) == TOP and document["systems"] == names and document["n_questions"] == 5 and len(document["rows"]) == 45 and set(document["rows"][0]) == ROW
    assert [(r["question_id"], r["system"]) for r in document["rows"][:10]] == [("q0", n) for n in names] + [("q1", "bm25")]
    assert all(r["answer"]["answer"].startswith("loud") and r["answer"]["tokens_used"] == 7 for r in document["rows"])
    claims = next(r for r in document["rows"] if r["system"] == "claims")["answer"]["citations"]
    pages = next(r for r in document["rows"] if r["system"] == "pages")["answer"]["citations"]
    assert [c["source_path"] for c in claims] == ["docs/facts.md"] == [c["source_path"] for c in pages]  # each source once
    assert pages[0]["span"].startswith("entity:concept:") and made["diagnosis"]["leader"] in names
    again = runs.load_comparison(spark, root / "out" / "report.json")
    assert again["metrics"] == made["metrics"] and again["rows"] == made["rows"] and again["diagnosis"] == made["diagnosis"]
    assert runs.compare(spark, again, made, "must_include_match", 0.0) == []
    assert (root / "said").exists() and not (root / "out" / "work").exists()
    with pytest.raises(config.ConfigError):
        runs.run_rag(spark, {"corpus": ["docs/*.md"], "questions": "q.jsonl", "systems": ["nope"]}, root, root / "out")


def test_systems_with_nothing_indexed(spark, root):  # noqa: F811
    questions = files.read_questions(spark, str(root / "q.jsonl"))
    chunks = spark.createDataFrame([], "doc string, ord struct<a:int>, source_path string, text string")
    for name, reason in (("claims", "empty_claim_index"), ("pages", "empty_page_index"), ("chunk_summary", "empty_chunk_index")):
        rows = Y.SYSTEMS[name](chunks, questions, Y.Context()).collect()
        assert len(rows) == 5 and {(r.refused, r.refusal_reason, r.answer) for r in rows} == {(True, reason, Y.EMPTY[reason])}
    vectors = Y.embedded(questions.limit(1), "question", ["id"], Mo.embedder(Loud)).first()
    assert vectors.vec == [1.0, 24.0]
