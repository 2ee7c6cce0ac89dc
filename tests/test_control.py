"""Configuration, registry, reports and whole runs on small files."""

import json

import pytest

from sextant.control import cli, config, registry, report, runs

DOCS = {"pay.md": "Payments settle nightly in batches.\n\nRefunds take three days to settle.", "auth.md": "Tokens expire after one hour.\n\nLogin needs a second factor."}
QUESTIONS = [
    {"id": f"q{i}", "tier": t, "question": q, "ground_truth_answer": a, "ground_truth_citations": c, "must_include_terms": m}
    for i, (t, q, a, c, m) in enumerate([("single_hop", "When do payments settle?", "nightly", ["pay.md"], ["nightly"]), ("single_hop", "When do tokens expire?", "after one hour", ["auth.md"], ["hour"]), ("multi_hop", "What does login need?", "second factor", ["auth.md"], ["factor"]), ("contradiction", "How long do refunds take?", "three days", ["pay.md"], ["days"]), ("single_hop", "Who owns the moon?", "", [], [])])
]


@pytest.fixture
def root(tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in DOCS.items():
        (tmp_path / "docs" / name).write_text(text)
    (tmp_path / "docs" / "bad.md").write_bytes(b"\xff\xfe")
    questions = [q | {"ground_truth_citations": [f"docs/{c}" for c in q["ground_truth_citations"]]} for q in QUESTIONS]
    (tmp_path / "q.jsonl").write_text("// header\n" + "\n".join(map(json.dumps, questions)))
    (tmp_path / "rag.yaml").write_text("corpus: [docs/*.md]\nquestions: q.jsonl\nsystems: bm25\njudge: mock\n")
    traces = [{"session_id": "s", "turn_id": i, "user_question": q, "retrieved_doc_ids": ["pay"], "gold_doc_ids": g, "agent_state": {"previous_answers": a}} for i, (q, g, a) in enumerate([("settle?", ["pay"], []), ("and that?", ["auth"], ["tokens expire"])])]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, traces)))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"doc_id": n[:-3], "text": t}) for n, t in DOCS.items()))
    return tmp_path


def test_project_files(tmp_path, monkeypatch):
    def load(text):
        (tmp_path / "p.yaml").write_text(text)
        return config.load_project(tmp_path / "p.yaml")

    spec = load("name: x\nrag: {config: r.yaml}\ntrace: {source: {input: e.json, format: otel}, policies: [recorded, recorded], gate: {policy: recorded, min_recall_at_5: 0.9}}\n")
    assert (spec.rag_config, spec.trace_source, spec.trace_format, spec.policies, spec.gates, spec.max_drop) == ("r.yaml", "e.json", "otel", ("recorded",), {"min_recall_at_5": 0.9}, 0.02)
    for bad in ("name: x", "rag: {}\nother: 1", "trace: {input: a, source: {input: b}}", "trace: {k: 3}", "trace: {input: a, gate: {}}", "- 1"):
        with pytest.raises(config.ConfigError):
            load(bad)
    monkeypatch.setenv("KEPT", "old")
    monkeypatch.delenv("FRESH", raising=False)
    (tmp_path / ".env").write_text("# c\nKEPT=new\nexport FRESH='v w'\nnonsense\n")
    assert config.load_env(tmp_path / ".env") == 1 and config.load_env(tmp_path / "none") == 0
    assert config.pick(None, {"a": {"b": 2}}, "a.b", 3) == 2 and config.pick(1, {}, "a") == 1 and config.pick(None, {}, "a.b", 3) == 3


def test_registry(tmp_path):
    first, folder = registry.reserve(tmp_path, "My Run!")
    assert first.endswith("-my-run") and registry.slug("x" * 60) == "x" * 48 and registry.slug(None) == ""
    registry.write(folder, registry.Manifest(first, "now", "passed"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest.json").write_text("{")
    assert [m.run_id for m in registry.runs(tmp_path)] == [first] and registry.read(folder).status == "passed"


def test_formats(tmp_path):
    assert [report.shown(x) for x in (None, float("nan"), 0.5, 1234.6, "t")] == ["n/a", "n/a", "0.500", "1,235", "t"]
    assert [report.grade(*x) for x in (("recall", 0.8), ("recall", 0.5), ("recall", 0.3), ("refusal_rate", 0.0), ("refusal_rate", 0.3), ("x", None))] == ["good", "warn", "bad", "good", "bad", ""]
    assert report.first_few(["a", "b", "c", "d"]) == "a, b, c, +1 more" and report.short("a  b" * 50, 10) == "a ba ba..."
    c = {"systems": ["a", "b"], "metrics": {"a": {"retrieval_source_recall": 0.945, "retrieval_source_precision": 0.547, "latency_ms_p50": 358.4}, "b": {}}}
    card = report.scorecard(c, ["later"])
    assert "| a | 82.6 | 94.5% | 54.7% | 358.4 |" in card and "| b | pending | pending | pending | pending |" in card and "| later | pending" in card
    (tmp_path / "r.md").write_text(f"x {report.BEGIN} old {report.END} y")
    assert report.inject(tmp_path / "r.md", card) and "82.6" in (tmp_path / "r.md").read_text() and "old" not in (tmp_path / "r.md").read_text()
    (tmp_path / "n.md").write_text(f"{report.END}{report.BEGIN}")
    assert not report.inject(tmp_path / "n.md", card)
    assert report.ordered_policies({"a": {"recall_5": 0.5, "zero_recall": 0.2}, "b": {"recall_5": 0.5, "zero_recall": 0.1}, "c": {"recall_5": None}}) == ["c", "b", "a"]


def test_run_of_a_project(spark, root, capsys):
    (root / "p.yaml").write_text(f"name: small\nregistry: {root}/runs\nrag: {{config: rag.yaml, primary_metric: retrieval_source_recall}}\ntrace: {{input: t.jsonl, corpus: c.jsonl, policies: [recorded, production_baseline], k: 2, gate: {{policy: recorded, min_recall_at_5: 0.1, max_zero_recall_at_k: 0.0}}}}\nartifacts: {{snapshot_inputs: true}}\n")
    code = cli.main(["project", "run", "--config", str(root / "p.yaml")])
    m = registry.runs(root / "runs")[0]
    folder = root / "runs" / m.run_id
    got = json.loads((folder / "rag" / "report.json").read_text())
    assert got["by_system_metric"]["bm25"]["retrieval_source_recall"] == 1.0 and got["n_per_tier"] == {"single_hop": 3, "multi_hop": 1, "contradiction": 1}
    assert json.loads((folder / "rag" / "diagnosis.json").read_text())["leader"] == "bm25" and m.summaries["leader"] == "bm25"
    policies = json.loads((folder / "traces_eval" / "metrics.json").read_text())["policies"]
    assert policies["production_baseline"]["recall_at_5"] == 0.5 and policies["recorded"]["n"] == 2
    assert code == (2 if m.failures else 0) and "<h2>Policies</h2>" in (folder / "report.html").read_text()
    assert (folder / "inputs" / "rag_config.yaml").exists() and len(m.digests["rag_config"]) == 64
    assert cli.main(["runs", "list", "--registry", str(root / "runs")]) == 0 and m.run_id in capsys.readouterr().out


def test_failed_run_has_a_manifest(spark, root):
    with pytest.raises(config.ConfigError):
        runs.create_run(spark, config.RunSpec(registry=str(root / "runs"), root=str(root), trace_input="t.jsonl"))
    assert registry.runs(root / "runs")[0].status == "error"
