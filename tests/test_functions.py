"""Column functions and small operators on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from sextant.functions import identity, text
from sextant.operators import claims as C
from sextant.operators import metrics as M
from sextant.operators import ranking as R
from sextant.operators import spans as S
from sextant.operators import traces as T
from sextant.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def fold(value, limit, overlap):
    """The chunk rule in plain Python."""
    out, buf, n = [], "", 0
    for p in (x.strip() for x in value.split("\n")):
        if not p:
            continue
        if not buf or n + len(p) + 2 <= limit:
            n = (n + 2 if buf else 0) + len(p)
            buf = f"{buf}\n\n{p}" if buf else p
        else:
            out.append(buf)
            tail = buf[-overlap:] if overlap else ""
            n = len(tail) + len(p)
            buf = f"{tail}\n\n{p}" if tail else p
    return [*out, buf] if buf else out


@pytest.mark.parametrize("value", ["", "a", "\n".join(["x" * 9, "y" * 30, "", "z" * 5, "w" * 14, "v" * 3])])
@pytest.mark.parametrize("limit,overlap", [(20, 4), (12, 0)])
def test_chunks(spark, value, limit, overlap):
    assert one(spark, value, lambda c: text.paragraph_chunks(c, "\n", limit, overlap)) == fold(value, limit, overlap)


def test_text(spark):
    assert one(spark, "Hello, wOrld_1 é", text.tokens) == ["hello", "world_1"]
    assert one(spark, None, text.tokens) == []
    assert tuple(one(spark, "  REFUSE: none\nmore", text.refusal)) == (True, "none")
    assert one(spark, "The Éval—Harness", text.normal_subject) == "éval harness"
    assert one(spark, "Payments v1.2.3", text.canonical_subject) == "payments"
    assert [one(spark, x, text.dropped_subject) for x in ("", "PR 12", "system", "ab", "0.1.0", "Payments")] == [True] * 5 + [False]
    assert one(spark, "Kubernetes AOSS bge-large kubernetes Kubernetes", text.entity_terms) == ["Kubernetes", "AOSS", "bge-large"]
    assert [tuple(x) for x in one(spark, "- a | b | c\nx | y\n* d | e | ", text.triples)] == [("a", "b", "c")]
    assert [one(spark, x, text.judge_score) for x in ("SCORE: 4.5", "score: 9", "none")] == [4.5, 5.0, 3.0]
    assert [one(spark, x, text.parent_id) for x in ("d::0001", "p#chunk-2", "p")] == ["d", "p", "p"]


def test_known_digest(spark):
    assert one(spark, "hello", lambda c: identity.joined_hash(c)) == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    a, b = (one(spark, "s", lambda c, u=u: identity.claim_id(c, F.lit("p"), F.lit(None).cast("string"), F.lit("q"), F.array(*map(F.lit, u)))) for u in (["x", "y"], ["y", "x"]))
    assert a == b


def test_bridge_answer_gain(spark):
    docs = spark.createDataFrame([("a", 0, "solar array control"), ("b", 1, "bridge component zephyr"), ("c", 2, "unrelated words")], "doc string, ord long, text string")
    q = spark.createDataFrame([("plain", "what of it"), ("bridge", "zephyr zephyr what of it"), ("empty", "???")], "qid string, query string")
    got = {(r.qid, r.doc) for r in R.bm25_rank(docs, q, 1, late_first=False, pad=False).collect()}
    assert got == {("bridge", "b")}
    padded = {r.qid: r.doc for r in R.bm25_rank(docs, q, 1).collect()}
    assert padded == {"plain": "c", "bridge": "b", "empty": "c"}


def test_metrics(spark):
    row = spark.createDataFrame([(["a", "b", "b"], ["b", "c", "d"], []), ], "x array<string>, y array<string>, z array<string>")
    got = row.select(M.precision(F.col("x"), F.col("y")), M.recall(F.col("x"), F.col("y")), M.recall(F.col("x"), F.col("z")), M.precision(F.col("z"), F.col("y"))).first()
    assert (got[0], got[1], got[2], got[3]) == (0.5, 1 / 3, None, None)
    base = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("e", 1.0)], "system string, value double")
    cand = spark.createDataFrame([("a", 0.5), ("b", 0.99), ("c", 1.0), ("d", 1.0), ("e", None)], "system string, value double")
    assert {(r.system, r.reason) for r in M.regression(base, cand, 0.02).collect()} == {("a", "metric dropped beyond threshold"), ("c", "missing metric in baseline report"), ("e", "missing metric in candidate report")}
    assert {(r.system, r.reason) for r in M.regression(base, cand, 0.02, ["d", "x", "b"]).collect()} == {("d", "missing system in baseline report"), ("x", "missing system in baseline report")}
    with pytest.raises(ValueError, match="no common systems"):
        M.regression(base.where("system = 'a'"), cand.where("system = 'd'"), 0.02)
    pairs = spark.createDataFrame([("m", i, 1.0, 0.5) for i in range(8)] + [("n", i, float(i % 3), float(i % 2)) for i in range(7)], "name string, qid long, a double, b double")
    got = {r.name: r for r in M.bootstrap(spark, pairs).collect()}
    assert (got["m"].ci_low, got["m"].ci_high) == (0.5, 0.5)
    rng, d = random.Random(0), [i % 3 - i % 2 for i in range(7)]
    means = sorted(sum(d[rng.randrange(7)] for _ in range(7)) / 7 for _ in range(2_000))
    assert (got["n"].ci_low, got["n"].ci_high, got["n"].n) == (pytest.approx(means[50]), pytest.approx(means[1949]), 7)


def test_gates_fail_closed(spark):
    schema = "policy string, n long, recall_5 double, recall_k double, zero_recall double, drift_1 double, stale_1 double, false_lead double"
    now = spark.createDataFrame([("recorded", 4, 0.5, 0.5, 0.3, 0.0, 0.2, 0.1), ("blank", 1, None, None, 0.0, 0.0, 0.0, 0.0)], schema)
    before = spark.createDataFrame([("recorded", 4, 0.75, 0.75, 0.1, 0.0, 0.2, 0.1), ("gone", 4, 0.75, 0.75, 0.1, 0.0, 0.2, 0.1)], schema)
    said = lambda df: sorted(r.message for r in df.collect())
    assert said(T.gate_failures(now, "recorded", min_recall_5=0.9, zero_recall=0.25, stale_1=0.2, false_lead=0.05)) == ["recorded.false_lead_at_k=0.100 violates <= 0.050", "recorded.recall_at_5=0.500 violates >= 0.900", "recorded.zero_recall_at_k=0.300 violates <= 0.250"]
    assert said(T.gate_failures(now, "gone", min_recall_5=0.1)) == ["policy `gone` was not evaluated"]
    assert said(T.gate_failures(now, "blank", min_recall_5=0.9)) == []
    assert said(T.gate_regressions(now, before, "recorded", max_recall_5_drop=0.1, zero_recall=0.1, stale_1=0.0)) == ["recorded.recall_at_5 delta=-0.250 drops more than 0.100", "recorded.zero_recall_at_k delta=+0.200 increases more than 0.100"]
    assert said(T.gate_regressions(now, before, "gone", max_recall_5_drop=0.1)) == ["policy `gone` was not evaluated"]
    assert said(T.gate_regressions(now, before, "blank", max_recall_5_drop=0.1)) == ["policy `blank` is missing from baseline metrics"]


def test_policy_texts(spark):
    row = spark.createDataFrame([("q", "n", ["f"], ["a1", "a2"], ["e1", "e2"], ["t", ""])], "q string, n string, f array<string>, p array<string>, e array<string>, t array<string>")
    c = F.col
    got = row.select(
        T.policy_text("compact_state", c("q"), F.lit(""), need=c("n"), known=c("f"), previous=c("p"), excluded=c("e")),
        T.policy_text("compact_state", c("q"), F.lit("")),
        T.policy_text("public_trace", c("q"), F.lit(""), trace=c("t")),
        T.policy_text("last_answer_x3", c("q"), F.lit("")),
        T.policy_text("recorded", c("q"), F.lit(""), recorded=F.lit("")),
    ).first()
    assert tuple(got) == ("Question: q Need: n Known: f | a1 | a2 Exclude: e1 | e2", "Question: q", "q t", "q", "q")
    with pytest.raises(ValueError, match="unknown policy"):
        T.policy_text("none", c("q"), F.lit(""))


def test_recall_counts_documents(spark):
    r = spark.createDataFrame([(["d::0002"], ["d::0001"])], "ids array<string>, gold array<string>")
    assert r.select(T.recall_at(F.col("ids"), F.col("gold"), 5)).first()[0] == 0.5


def test_otlp_spans(spark):
    doc = '{"resourceSpans":[{"resource":{"attributes":[{"key":"a","value":{"stringValue":"r"}},{"key":"b","value":{"stringValue":"r"}}]},"scopeSpans":[{"spans":[{"traceId":"t","spanId":"s","name":"retrieve","attributes":[{"key":"b","value":{"stringValue":"own"}},{"key":"retrieval.documents.1.document.id","value":{"stringValue":"y"}},{"key":"retrieval.documents.0.document.id","value":{"stringValue":"x"}}]}]}]}]}'
    spans = S.otlp_spans(spark.createDataFrame([(doc,)], "value string"))
    row = spans.first()
    assert row.attributes["a"] == "r" and row.attributes["b"] == "own"
    assert S.indexed_documents(spans).first().ids == ["x", "y"]
    v = spark.createDataFrame([('{"a":{"b.c":""},"a.b.c":[],"x":0}',)], "j string").select(F.try_parse_json("j").alias("v"))
    assert v.select(S.first_value(F.col("v"), ("a.b.c", "x"))).first()[0] == "0"


def test_claims_round_trip(spark):
    schema = "claim_id string, subject string, proof_sets array<struct<proof_set_id:string,sources:array<string>,acl_labels:array<string>>>"
    rows = [("c1", "s", [("p1", ["u2", "u1"], ["b", "a"]), ("p2", ["u3"], [])])]
    df = spark.createDataFrame(rows, schema)
    back = C.claims_from_rows(C.claim_rows(df)).first()
    assert [(p.proof_set_id, p.sources, p.acl_labels) for p in back.proof_sets] == [("p1", ["u2", "u1"], ["a", "b"]), ("p2", ["u3"], [])]


def test_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('// note\n\n{"id":"1","question":"q"}\n')
    assert [(r.id, r.must_include_terms) for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).collect()] == [("1", [])]
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "good.md").write_text("hi")
    assert [r.text for r in files.read_documents(spark, [str(tmp_path / "*.md"), str(tmp_path / "g*.md")]).collect()] == ["hi"]
    (tmp_path / "x.json").write_text('[{"a":1}, 2]')
    assert files.read_export(spark, str(tmp_path / "x.json")).count() == 1
    files.write_manifest(spark, str(tmp_path / "m"), "ad", "h", {"k": "v"})
    assert files.read_manifest(spark, str(tmp_path / "m"), "ad", "h").count() == 1
    with pytest.raises(files.ManifestError):
        files.read_manifest(spark, str(tmp_path / "m"), "ad", "other")
    with pytest.raises(files.BudgetExceeded):
        files.preflight(21.0, 1)


def test_mock_vectors_count_without_a_pass_over_the_vector_for_each_word(spark):
    import hashlib
    import re

    from sextant.control.systems import mock_embed

    texts = ["", None, "One", "a b a b A_b", "é x-y 12 " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mock_embed(F.col("t")).alias("v"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", texts[r.i] or "")]
        want = [0.0] * 64
        for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
            want[hashlib.sha1(g.encode()).digest()[-1] % 64] += 1
        assert r.v == want


def test_corpus_hash_goes_on_from_task_to_task(spark):
    """In ranges of any size, of unlike lengths, the digest is that of all bytes in order."""
    import hashlib

    from sextant.functions import identity

    rows = [(f"d/{i % 37:03d}", i, "x" * (i * 7 % 90) + "\u00e9" * (i % 5)) for i in range(300)] + [("d/999", 0, "y" * 5_000), ("d/998", 0, "")]
    chunks = spark.createDataFrame(rows, "source_path string, chunk_index int, text string").repartition(7)
    want = hashlib.sha256(b"".join(f"{p}\0{i}\0{t}\n".encode() for p, i, t in sorted(rows))).hexdigest()
    assert identity.Sha256.usable()
    for size in (1 << 28, 9_000, 3_000):
        assert [r.corpus_hash for r in identity.corpus_hash(chunks, size=size).collect()] == [want]


def test_a_digest_stops_and_goes_on():
    import hashlib

    from sextant.functions.identity import Sha256

    data = bytes(range(256)) * 9
    for cut in (0, 1, 63, 64, 65, 1_000, len(data)):
        first = Sha256()
        first.update(data[:cut])
        first.hexdigest()  # leaves the state as it is
        then = Sha256(first.state())
        then.update(data[cut:])
        assert then.hexdigest() == hashlib.sha256(data).hexdigest()
