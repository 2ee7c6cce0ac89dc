"""Span exports of several shapes to trace rows."""

import json

import pytest
from pyspark.sql import functions as F

from sextant.operators import spans as S
from sextant.sources import files


def rows_of(spark, *items):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "ord long, j string")
    return df.select(F.parse_json("j").alias("row"), "ord")


def attribute(key, **value):
    return {"key": key, "value": value}


def test_otlp_document(spark):
    root = {"traceId": "t1", "spanId": "s0", "name": "turn", "attributes": [attribute("input.value", stringValue="What is it?"), attribute("ours.gold_doc_ids", arrayValue={"values": [{"stringValue": "g1"}, {"stringValue": "g2"}]}), attribute("ours.agent_state.previous_answers", arrayValue={"values": [{"stringValue": "before"}]})]}
    found = {"traceId": "t1", "spanId": "s1", "parentSpanId": "s0", "name": "lookup", "attributes": [attribute("openinference.span.kind", stringValue="RETRIEVER"), attribute("retrieval.query", stringValue="it"), attribute("retrieval.documents.1.document.id", stringValue="d2"), attribute("retrieval.documents.0.document.id", stringValue="d1"), attribute("retrieval.documents.0.document.score", doubleValue=0.5), attribute("session.id", stringValue="own")]}
    doc = {"resourceSpans": [{"resource": {"attributes": [attribute("session.id", stringValue="inherited"), attribute("shared", intValue="7")]}, "scopeSpans": [{"spans": [root, found, "no span"]}]}]}
    got = S.normalise_export(rows_of(spark, doc), vendor="ours").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.session_id, r.turn_id, r.user_question, r.retrieval_query) == ("inherited", "s1", "What is it?", "it")  # the trace's first span has it
    assert r.retrieved_doc_ids == ["d1", "d2"] and r.gold_doc_ids == ["g1", "g2"]
    assert r.agent_state.previous_answers == ["before"] and r.agent_state.public_trace == [] and r.current_need is None
    flat = {x.span_id: x for x in S.otlp_spans(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()}
    assert flat["s0"].attributes["session.id"] == "inherited" and flat["s1"].attributes["session.id"] == "own" and flat["s1"].parent_id == "s0"


@pytest.mark.parametrize("shape", [lambda x: {"scopeSpans": [{"spans": [x]}]}, lambda x: {"instrumentationLibrarySpans": [{"spans": [x]}]}, lambda x: {"spans": [x]}, lambda x: x, lambda x: {"resourceSpans": [{"instrumentationLibrarySpans": [{"spans": [x]}]}]}])
def test_containers(spark, shape):
    span = {"context": {"trace_id": "t"}, "id": "s", "span_name": "Search docs", "question": "q?", "attributes": {"retrieved_doc_ids": '["a", {"metadata": {"id": "b"}}]'}}
    r = S.normalise_export(rows_of(spark, shape(span)), source="otel").collect()
    assert [(x.session_id, x.turn_id, x.user_question, x.retrieved_doc_ids) for x in r] == [("t", "s", "q?", ["a", "b"])]


def test_typed_values():
    value = {"kvlistValue": {"values": [{"key": "k", "value": {"arrayValue": {"values": [{"doubleValue": 1.5}, {"boolValue": True}, {"intValue": "3"}]}}}, {"key": "b", "value": {"bytesValue": "eA=="}}]}}
    assert [S.typed_value(x) for x in (value, {"stringValue": 'say "x"'}, "plain", {"other": 1}, {"arrayValue": 1})] == [{"k": [1.5, True, "3"], "b": "eA=="}, 'say "x"', "plain", {"other": 1}, []]


def test_lists(spark):
    items = ["x", "", None, "5", '{"document": {"id": "n"}}', '{"nothing": 1}', '["a", ["b", {"chunk_id": "c"}, [[["deep"]]]], null, ""]', '["j", "{\\"id\\": \\"k\\"}"]', "[not json", '{"id": ""}', "[true, 2]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "ord long, t string")
    got = [r.v for r in df.orderBy("ord").select(S.as_list("t").alias("v")).collect()]
    assert got == [["x"], [], [], ["5"], ["n"], [], ["a", "b", "c", "deep"], ["j", "k"], ["[not json"], [], ["True", "2"]]
    got = [r.v for r in rows_of(spark, ["a", "", 2], "s", "", None, 4).orderBy("ord").select(S.as_tuple(F.col("row")).alias("v")).collect()]
    assert got == [["a", "2"], ["s"], [], [], ["4"]]


def test_paths(spark):
    df = rows_of(spark, {"a": {"b.c": ""}, "a.b.c": [], "x": 0}, {"a": {"b": {"c": "deep"}}}, {"a": {"b.c": "half"}})
    got = [r.v for r in df.orderBy("ord").select(S.first_value(F.col("row"), ("a.b.c", "x")).alias("v")).collect()]
    assert got == ["0", "deep", "half"]


def test_router(spark):
    plain = [{"session_id": "s", "question": "q"}, {"attributes": {"a": 1}}]
    seen = [{"traceId": "x"}, {"attributes": []}, {"attributes": {"span.kind": "Retriever"}}, {"scopeSpans": []}]
    got = [r.v for r in rows_of(spark, *plain, *seen).orderBy("ord").select(S.looks_observed(F.col("row")).alias("v")).collect()]
    assert got == [False, False, True, True, True, True]


def test_without_retriever_spans(spark):
    spans = [{"trace_id": "t", "span_id": "a", "name": "plan", "question": "q"}, {"trace_id": "t", "span_id": "b", "name": "act", "current_need": "n"}, {"trace_id": "", "span_id": "c", "name": "x"}]
    got = {r.turn_id: r for r in S.normalise_export(rows_of(spark, *spans), source="phoenix", require_question=False).collect()}
    assert len(got) == 3 and got["b"].user_question == "q" and got["a"].current_need == "n" and got["c"].user_question == ""


def test_trace_and_corpus_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, [{"session_id": "s", "turn_id": 0, "question": "q", "agent_state": {"answers": ["a", ""], "current_need": "n"}, "retrieved_doc_ids": "d", "gold_ids": ["g"]}, {"step_id": "x", "user_question": None, "current_need": "own"}])) + "\n\n")
    a, b = files.read_traces(spark, str(tmp_path / "t.jsonl")).orderBy("ord").collect()
    assert (a.session_id, a.turn_id, a.user_question, a.current_need, a.previous_answers, a.retrieved_ids, a.gold_ids) == ("s", "0", "q", "n", ["a"], ["d"], ["g"])
    assert (b.session_id, b.turn_id, b.user_question, b.current_need, b.previous_answers) == ("", "x", "None", "own", [])
    body = " ".join(f"w{i}" for i in range(600))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, [{"id": "a", "text": "whole"}, {"doc_id": "b", "title": "T", "abstract": "A", "body": body}, {"chunk_id": "c", "title": "", "body": ""}, {"doc_id": "d", "chunk_id": "d::7", "text": "x"}])))
    got = [(r.chunk_id, r.doc_id, r.text) for r in files.read_corpus(spark, str(tmp_path / "c.jsonl")).orderBy("ord").collect()]
    words = body.split()
    assert got == [("a", "a", "whole"), ("b::0000", "b", "T\n\nA"), ("b::0001", "b", " ".join(words[:350])), ("b::0002", "b", " ".join(words[270:620])), ("b::0003", "b", " ".join(words[540:])), ("d::7", "d", "x")]
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "z"}')
    with pytest.raises(Exception, match="corpus row without text"):
        files.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_exports(spark, tmp_path):
    one = {"conversation_id": "c", "input": {"question": "q"}}
    for name, text in (("a", json.dumps([one, 3, one])), ("b", json.dumps(one)), ("c", json.dumps(one) + "\n\n" + json.dumps(one)), ("d", json.dumps(one, indent=2)), ("e", "")):
        (tmp_path / name).write_text(text)
    assert [files.read_export(spark, str(tmp_path / x)).count() for x in "abcde"] == [2, 1, 2, 1, 0]
    rows = S.normalise_export(files.read_export(spark, str(tmp_path / "a")))
    assert files.write_traces(rows, str(tmp_path / "out")) == 2
    assert files.read_traces(spark, str(tmp_path / "out")).first().user_question == "q"


def test_retriever_responses(spark):
    df = spark.createDataFrame([("a", '["x", {"id": "y", "score": "0.5"}, 3, {"metadata": {"chunk_id": "m"}, "relevance": 2}]'), ("b", '{"hits": [{"document": {"doc_id": "n"}, "_score": "none"}, {"no": 1}]}')], "key string, j string").select("key", F.parse_json("j").alias("response"))
    got = [(r.key, r.id, r.score) for r in S.retriever_results(df).orderBy("key", "place").collect()]
    assert got == [("a", "x", 0.0), ("a", "y", 0.5), ("a", "m", 2.0), ("b", "n", 0.0)]
    with pytest.raises(Exception, match="must be a list"):
        S.retriever_results(spark.createDataFrame([("a", '{"x": 1}')], "key string, j string").select("key", F.parse_json("j").alias("response"))).collect()
