"""Observability exports to normalised trace rows, by path lists over VARIANT values.

A row of an export is a VARIANT (column row) with its place (column ord). A value counts as there unless it is
null, "" or []; 0, false and {} are values. ``vendor`` is the prefix under which an exporter keeps its own attributes.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Where the fields of a trace row are looked for, in this order.
SESSION = ("session_id", "conversation_id", "trace_id", "attributes.session.id", "attributes.session_id", "metadata.session_id")
TURN = ("turn_id", "step_id", "span_id", "id", "attributes.turn_id", "attributes.step_id")
QUESTION = ("user_question", "question", "input.question", "input", "attributes.user_question", "attributes.question", "attributes.input.value", "metadata.user_question")
QUERY = ("retrieval_query", "query", "input.query", "attributes.retrieval.query", "attributes.query", "attributes.input.value")
NEED = ("current_need", "attributes.current_need", "attributes.agent_state.current_need", "metadata.current_need")
RETRIEVED = ("retrieved_doc_ids", "retrieved_chunk_ids", "retrieved_ids", "documents", "output.documents", "attributes.retrieval.documents", "attributes.retrieval.documents_json", "attributes.retrieved_documents", "attributes.retrieved_doc_ids")
GOLD = ("gold_doc_ids", "gold_chunk_ids", "gold_ids", "labels.gold_doc_ids", "metadata.gold_doc_ids", "attributes.{vendor}.gold_doc_ids", "attributes.gold_doc_ids")
STATE = ("previous_answers", "previous_doc_ids", "false_lead_doc_ids", "public_trace")
STATE_PATHS = ("{}", "attributes.agent_state.{}", "attributes.state.{}", "attributes.{{vendor}}.agent_state.{}", "metadata.{}")
IDS = ("doc_id", "document_id", "chunk_id", "id", "source_id", "metadata.doc_id", "metadata.document_id", "metadata.chunk_id", "metadata.id", "metadata.source_id", "document.id", "document.doc_id", "document.document_id")
#: Where a trace's context is looked for in its spans.
CONTEXT = {
    "session_id": ("session_id", "attributes.session.id", "attributes.session_id", "attributes.conversation.id", "attributes.thread.id"),
    "user_question": ("user_question", "question", "attributes.user_question", "attributes.question", "attributes.input.value", "input.value", "input"),
    "gold_doc_ids": ("gold_doc_ids", "attributes.{vendor}.gold_doc_ids", "attributes.gold_doc_ids", "metadata.gold_doc_ids"),
    "current_need": ("current_need", "attributes.current_need", "attributes.{vendor}.current_need"),
}
KINDS = ("openinference.span.kind", "span.kind", "otel.kind")
SPAN_LISTS = ("scopeSpans", "instrumentationLibrarySpans")


def _named(paths: tuple[str, ...], vendor: str | None) -> tuple[str, ...]:
    """The paths with the vendor's prefix; those that need one are left out without it."""
    return tuple(p.replace("{vendor}", vendor or "") for p in paths if vendor or "{vendor}" not in p)


def _options(path: str) -> list[str]:
    """A path's readings as variant paths: the literal key, then the walk with ever more of it as one dotted key."""
    parts = path.split(".")
    keys = [[path]] + [[*parts[:i], ".".join(parts[i:])] for i in range(1, len(parts))]
    return ["$" + "".join(f'["{p}"]' for p in k) for k in keys]


def path_value(v: Column, path: str) -> Column:
    """A dotted path in a variant, as text: the literal key first, then the walk, with the rest as a dotted key where it breaks."""
    return F.coalesce(*[F.try_variant_get(v, o, "string") for o in _options(path)])


def _there(c: Column) -> Column:
    return F.when((c != "") & (c != "[]"), c)


def first_value(v: Column, paths: tuple[str, ...]) -> Column:
    """The first value that is there, as text."""
    return F.coalesce(*[_there(path_value(v, p)) for p in paths])


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """A scalar as text; truth values as True and False."""
    s = F.try_variant_get(v, "$", "string")
    return F.when(_kind(v) == "BOOLEAN", F.initcap(s)).otherwise(s)


def _ids(x) -> list[str]:
    """Ids in a decoded value of any depth."""
    if isinstance(x, list):
        return [i for y in x for i in _ids(y)]
    if isinstance(x, dict):
        for path in IDS:
            head, _, rest = path.partition(".")
            got = x.get(path) or (x[head].get(rest) if rest and isinstance(x.get(head), dict) else None)
            if got:
                return [str(got)]
        return []
    if isinstance(x, str):
        inner = _decoded(x)
        return ([x] if x else []) if inner is None else _ids(inner)
    return [] if x is None else [str(x)]


def _decoded(text: str):
    """A list or object from JSON text, None for any other text."""
    if text.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(text)
        except ValueError:
            return None
    return None


@F.pandas_udf(ArrayType(StringType()))
def as_list(s: pd.Series) -> pd.Series:
    """array<string> of a value's text: a plain text is itself; of JSON the ids of objects and the members of lists, flattened to any depth."""
    return s.map(lambda t: [] if t is None else _ids(t))


def as_tuple(v: Column) -> Column:
    """array<string> of a list's members or of one value, blank ones left out."""
    none = F.array().cast("array<string>")
    many = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), _text), lambda s: F.coalesce(s, F.lit("")) != "")
    single = F.when(F.coalesce(_text(v), F.lit("")) != "", F.array(_text(v))).otherwise(none)
    return F.when(v.isNull() | (_kind(v) == "VOID"), none).when(_kind(v).startswith("ARRAY"), many).otherwise(single)


def has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f'$["{key}"]', "variant").isNotNull()


def agent_state(v: Column, vendor: str | None = None, known: dict[str, Column] | None = None) -> Column:
    """struct of the four lists of an agent's state; one that the row's own state has wins, then what is ``known`` of the trace."""

    def field(k: str) -> Column:
        said = first_value(v, _named(tuple(p.format(k) for p in STATE_PATHS), vendor))
        if known:
            said = F.when(has(v, "agent_state"), said).otherwise(F.coalesce(known[k], said))
        given = F.try_variant_get(v, f"$.agent_state.{k}", "variant")
        return as_list(F.when(given.isNotNull(), F.try_variant_get(v, f"$.agent_state.{k}", "string")).otherwise(said))

    return F.struct(*[field(k).alias(k) for k in STATE])


def indexed_ids(v: Column) -> Column:
    """array<string>: ids of attributes 'retrieval.documents.N.(document.)field', in order of N."""
    attributes = F.try_variant_get(v, "$.attributes", "map<string,string>")
    n = F.filter(F.transform(F.map_keys(attributes), lambda k: F.regexp_extract(k, r"^retrieval\.documents\.(\d+)\.", 1)), lambda x: x != "")
    order = F.array_sort(F.array_distinct(F.transform(n, lambda x: x.cast("int"))))
    at = lambda i, f: F.coalesce(*[_there(F.try_element_at(attributes, F.concat(F.lit("retrieval.documents."), i.cast("string"), F.lit(f".{m}{f}")))) for m in ("", "document.")])
    found = F.transform(order, lambda i: F.coalesce(*[at(i, f) for f in IDS]))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _blank(c: Column) -> Column:
    """Empty where a value is falsy."""
    return F.when(F.coalesce(c, F.lit("")).isin("0", "false", "{}"), "").otherwise(F.coalesce(c, F.lit("")))


def normalised(rows: DataFrame, vendor: str | None = None, context: str = "") -> DataFrame:
    """session_id, turn_id, user_question, retrieval_query, retrieved_doc_ids, gold_doc_ids, agent_state, current_need, ord.

    ``context`` is the prefix of columns with what the row's trace says; they stand in for the plain key where the row lacks it.
    """
    v = F.col("row")

    def value(key: str, paths: tuple[str, ...]) -> Column:
        paths = _named(paths, vendor)
        return F.coalesce(_there(path_value(v, key)), F.col(context + key), first_value(v, paths)) if context else first_value(v, paths)

    question, query = _blank(value("user_question", QUESTION)), _blank(first_value(v, QUERY))
    listed = first_value(v, RETRIEVED)
    found = F.when(listed.isNotNull(), as_list(listed)).otherwise(indexed_ids(v))
    known = {k: F.col(context + k) for k in STATE} if context else None
    return rows.select(
        _blank(value("session_id", SESSION)).alias("session_id"), _blank(first_value(v, TURN)).alias("turn_id"), question.alias("user_question"),
        F.coalesce(F.nullif(query, F.lit("")), question).alias("retrieval_query"), found.alias("retrieved_doc_ids"),
        as_list(value("gold_doc_ids", GOLD)).alias("gold_doc_ids"), agent_state(v, vendor, known).alias("agent_state"), F.nullif(_blank(value("current_need", NEED)), F.lit("")).alias("current_need"), "ord",
    )


def typed_value(x):
    """A decoded typed value (stringValue, arrayValue, kvlistValue, ...) as a plain one; others as they are."""
    if not isinstance(x, dict):
        return x
    for kind in ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue"):
        if kind in x:
            return x[kind]
    for kind in ("arrayValue", "kvlistValue"):
        if kind in x:
            held = x[kind].get("values") or [] if isinstance(x[kind], dict) else []
            return [typed_value(y) for y in held] if kind == "arrayValue" else {str(y.get("key")): typed_value(y.get("value")) for y in held if isinstance(y, dict)}
    return x


def _plain(attributes) -> dict:
    """Attributes, a list of typed pairs or an object, as an object."""
    if isinstance(attributes, list):
        return {str(a["key"]): typed_value(a.get("value")) for a in attributes if isinstance(a, dict) and a.get("key")}
    return attributes if isinstance(attributes, dict) else {}


@F.pandas_udf(StringType())
def merged_attributes(inherited: pd.Series, own: pd.Series) -> pd.Series:
    """JSON text of a span's attributes over those of its resource."""
    read = lambda t: _plain(json.loads(t)) if t else {}
    return pd.Series([json.dumps(read(a) | read(b)) for a, b in zip(inherited, own, strict=True)], dtype="object")


def _members(v: Column, *keys: str) -> Column:
    """The objects of the first list among ``keys`` that is not empty."""
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys]
    some = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>"))
    return F.filter(some, lambda x: _kind(x).startswith("OBJECT"))


def spans_of(rows: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_span_id, name, row, ord) of the spans in an export's rows, flattened.

    Spans stand under resourceSpans, scopeSpans, instrumentationLibrarySpans or spans, or are rows themselves. A resource's
    attributes are inherited, a span's own win.
    """
    v, none = F.col("row"), F.lit(None).cast("variant")
    shape = F.when(has(v, "resourceSpans"), 1).when(has(v, "scopeSpans") | has(v, "instrumentationLibrarySpans"), 2).when(_kind(F.try_variant_get(v, "$.spans", "variant")).startswith("ARRAY"), 3).otherwise(0)
    rows = rows.withColumn("_shape", shape)
    one = rows.where("_shape = 1").select("ord", F.posexplode(_members(v, "resourceSpans")).alias("i", "r"))
    one = one.select("ord", "i", F.try_variant_get("r", "$.resource.attributes", "variant").alias("inherited"), F.posexplode(_members(F.col("r"), *SPAN_LISTS)).alias("j", "s"))
    one = one.select("ord", "i", "j", "inherited", F.posexplode(_members(F.col("s"), "spans")).alias("k", "span"))
    two = rows.where("_shape = 2").select("ord", F.lit(0).alias("i"), none.alias("inherited"), F.posexplode(_members(v, *SPAN_LISTS)).alias("j", "s")).select("ord", "i", "j", "inherited", F.posexplode(_members(F.col("s"), "spans")).alias("k", "span"))
    three = rows.where("_shape = 3").select("ord", F.lit(0).alias("i"), F.lit(0).alias("j"), none.alias("inherited"), F.posexplode(_members(v, "spans")).alias("k", "span"))
    plain = rows.where("_shape = 0").select("ord", F.lit(0).alias("i"), F.lit(0).alias("j"), none.alias("inherited"), F.lit(0).alias("k"), v.alias("span"))
    s = F.col("span")
    pick = lambda *paths: F.coalesce(*[F.nullif(_blank(path_value(s, p)), F.lit("")) for p in paths], F.lit(""))
    attributes = lambda c: F.to_json(c)
    flat = reduce(DataFrame.unionByName, (one, two, three, plain)).select(
        F.struct("ord", "i", "j", "k").alias("ord"), s.alias("span"),
        pick("trace_id", "traceId", "context.trace_id", "context.traceId").alias("trace_id"), pick("span_id", "spanId", "context.span_id", "context.spanId", "id").alias("span_id"),
        pick("parent_span_id", "parentSpanId", "parent_id").alias("parent_span_id"), pick("name", "span_name").alias("name"),
        merged_attributes(attributes(F.col("inherited")), attributes(F.try_variant_get(s, "$.attributes", "variant"))).alias("_attributes"),
    )
    # The span with its ids, name and attributes under their plain keys.
    rest = F.map_filter(F.try_variant_get(s, "$", "map<string,variant>"), lambda k, _: ~k.isin("trace_id", "span_id", "parent_span_id", "name", "attributes"))
    text = lambda c: F.parse_json(F.to_json(F.struct(F.col(c).alias("v"))))
    extra = F.map_from_arrays(F.array(*map(F.lit, ("trace_id", "span_id", "parent_span_id", "name", "attributes"))), F.array(*[F.try_variant_get(text(c), "$.v", "variant") for c in ("trace_id", "span_id", "parent_span_id", "name")], F.parse_json("_attributes")))
    return flat.withColumn("_row", F.parse_json(F.to_json(F.map_concat(rest, extra)))).select("trace_id", "span_id", "parent_span_id", "name", F.col("_row").alias("row"), "ord")


def otlp_spans(docs: DataFrame) -> DataFrame:
    """Spans of documents (column value, JSON text) with their attributes as a map of texts."""
    rows = docs.select(F.parse_json("value").alias("row"), F.monotonically_increasing_id().alias("ord"))
    s = spans_of(rows)
    return s.select("trace_id", "span_id", F.col("parent_span_id").alias("parent_id"), "name", F.try_variant_get("row", "$.attributes", "map<string,string>").alias("attributes"), "row", "ord")


def span_kind(v: Column) -> Column:
    return F.lower(F.coalesce(*[F.nullif(F.try_variant_get(v, f'$.attributes["{k}"]', "string"), F.lit("")) for k in KINDS], F.lit("")))


def is_retriever(kind: Column, name: Column) -> Column:
    """By the kind attribute, or else by the span's name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (F.lower(F.coalesce(kind, F.lit(""))) == "retriever") | F.contains(low, F.lit("retriev")) | F.contains(low, F.lit("search"))


def looks_observed(v: Column) -> Column:
    """Whether a row is a span export's: its containers, its camel-case ids, listed attributes, or a retriever's kind."""
    marks = [has(v, k) for k in ("resourceSpans", *SPAN_LISTS, "traceId", "spanId", "parentSpanId")]
    listed = _kind(F.try_variant_get(v, "$.attributes", "variant")).startswith("ARRAY")
    return reduce(Column.__or__, marks) | F.coalesce(listed, F.lit(False)) | (span_kind(v) == "retriever")


def trace_context(spans: DataFrame, fields: list[str]) -> DataFrame:
    """(trace_id, fields...): of each field the first value that is there, in span order (column ord)."""
    return spans.groupBy("trace_id").agg(*[F.min_by(F.col(f), F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("ord"))).alias(f) for f in fields])


def normalised_spans(rows: DataFrame, vendor: str | None = None) -> DataFrame:
    """Trace rows of a span export: its retriever spans, or all if it has none, each with what its trace's spans say.

    What a span lacks comes from the first span of the trace that has it; retriever spans give no question.
    """
    v = F.col("row")
    spans = spans_of(rows).withColumn("_hit", is_retriever(span_kind(v), F.col("name"))).persist()
    said = {k: first_value(v, _named(p, vendor)) for k, p in CONTEXT.items()}
    said["user_question"] = F.when(~F.col("_hit"), said["user_question"])
    state = {k: first_value(v, _named(tuple(p.format(k) for p in ("agent_state.{}", *STATE_PATHS)), vendor)) for k in STATE}
    texts = spans.where("trace_id <> ''").select("trace_id", "ord", *[c.alias(k) for k, c in (said | state).items()])
    context = trace_context(texts, [*said, *state])
    context = context.select(F.col("trace_id").alias("_trace"), *[F.col(k).alias(f"_of_{k}") for k in (*said, *state)])
    used = spans.where(F.col("_hit") | F.lit(spans.where("_hit").isEmpty()))
    return normalised(used.join(context, F.col("trace_id") == F.col("_trace"), "left"), vendor, "_of_")


def normalise_export(rows: DataFrame, *, source: str = "auto", require_question: bool = True, require_gold: bool = False, vendor: str | None = None) -> DataFrame:
    """Trace rows of an export (row, ord), by spans or row by row; ``source`` otel, opentelemetry or phoenix means spans, auto looks."""
    by_spans = source.lower() in ("otel", "opentelemetry", "phoenix") or (source.lower() == "auto" and not rows.where(looks_observed(F.col("row"))).isEmpty())
    out = normalised_spans(rows, vendor) if by_spans else normalised(rows, vendor)
    if require_question:
        out = out.where("user_question <> ''")
    return out.where(F.size("gold_doc_ids") > 0) if require_gold else out


def indexed_documents(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, ids): 'retrieval.documents.N.document.id' attributes (a map) in order of N."""
    e = spans.select("trace_id", "span_id", F.explode("attributes").alias("k", "v"))
    n = F.regexp_extract("k", r"^retrieval\.documents\.(\d+)\.(?:document\.)?id$", 1)
    found = e.where(n != "").select("trace_id", "span_id", n.cast("int").alias("n"), "v")
    return found.groupBy("trace_id", "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("ids"))


# Trace and corpus files


def _said(v: Column, *keys: str) -> Column:
    """The first of ``keys`` that the row has, as text; a JSON null is the text None, as the files' readers have it."""
    out = None
    for k in keys:
        got = F.try_variant_get(v, f"$.{k}", "variant")
        text = F.when(_kind(got) == "VOID", "None").otherwise(_text(got))
        out = F.when(got.isNotNull(), text) if out is None else out.when(got.isNotNull(), text)
    return out.otherwise(F.lit(""))


def _truthy(v: Column, *paths: str) -> Column:
    """The first value of the paths (of plain keys) that is not empty, as a variant."""
    return F.coalesce(*[F.when(~_blank(F.try_variant_get(v, f"$.{p}", "string")).isin("", "[]"), F.try_variant_get(v, f"$.{p}", "variant")) for p in paths])


def trace_records(rows: DataFrame) -> DataFrame:
    """Typed trace records of rows (row, ord), under any of the names that trace files use."""
    v = F.col("row")
    many = lambda *paths: as_tuple(_truthy(v, *paths))
    need = F.when(has(v, "current_need"), _said(v, "current_need")).otherwise(F.coalesce(F.try_variant_get(v, "$.agent_state.current_need", "string"), F.lit("")))
    return rows.select(
        _said(v, "session_id").alias("session_id"), _said(v, "turn_id", "step_id").alias("turn_id"), _said(v, "user_question", "question").alias("user_question"), _said(v, "retrieval_query").alias("retrieval_query"), need.alias("current_need"),
        many("agent_state.previous_answers", "agent_state.answers", "previous_answers").alias("previous_answers"), many("agent_state.known_facts", "agent_state.known_evidence").alias("known_facts"),
        many("agent_state.excluded_leads").alias("excluded_leads"), many("agent_state.public_trace", "public_trace").alias("public_trace"),
        many("retrieved_chunk_ids", "retrieved_doc_ids", "retrieved_ids").alias("retrieved_ids"), many("gold_chunk_ids", "gold_doc_ids", "gold_ids").alias("gold_ids"),
        many("agent_state.previous_doc_ids", "previous_doc_ids").alias("previous_doc_ids"), many("agent_state.false_lead_doc_ids", "false_lead_doc_ids").alias("false_lead_doc_ids"), v.alias("raw"), "ord",
    )


def corpus_records(rows: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, text, ord) of corpus rows (row, ord): texts as they are, or title, abstract and body in word windows."""
    v = F.col("row")
    doc = F.coalesce(_text(_truthy(v, "doc_id", "id", "chunk_id")), F.lit("None"))
    base = rows.select("ord", doc.alias("doc_id"), has(v, "text").alias("whole"), (has(v, "title") | has(v, "abstract") | has(v, "body")).alias("parts"), _text(_truthy(v, "chunk_id")).alias("chunk"), _said(v, "text").alias("text"), _said(v, "title").alias("title"), _said(v, "abstract").alias("abstract"), _said(v, "body").alias("body"), v.alias("raw"))
    whole = base.where("whole").select(F.coalesce("chunk", "doc_id").alias("chunk_id"), "doc_id", "text", F.struct("ord", F.lit(0).alias("place")).alias("ord"))
    return whole.unionByName(manifest_chunks(base.where(~F.col("whole")).withColumn("title", F.when(F.col("parts"), F.col("title")).otherwise(F.raise_error(F.concat(F.lit("corpus row without text, title, abstract or body: "), F.to_json("raw")))))))


def manifest_chunks(docs: DataFrame, *, size: int = 350, overlap: int = 80) -> DataFrame:
    """(chunk_id, doc_id, text, ord) of documents (doc_id, title, abstract, body, ord): 'id::0000' has title and abstract, windows of the body follow."""
    from ..functions.text import word_windows

    filled = F.filter(F.array("title", "abstract"), lambda x: F.coalesce(x, F.lit("")) != "")
    windows = word_windows(F.col("body"), size, overlap)
    pieces = docs.select("doc_id", "ord", F.posexplode(F.concat(F.array(F.array_join(filled, "\n\n")), windows)).alias("place", "text"), F.size(windows).alias("n"))
    kept = pieces.where((F.col("place") > 0) | (F.col("n") > 0) | F.col("text").rlike(r"(?U)\S"))
    return kept.select(F.concat("doc_id", F.lit("::"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("chunk_id"), "doc_id", "text", F.struct("ord", "place").alias("ord"))


def retriever_results(responses: DataFrame) -> DataFrame:
    """(key, place, id, score) of a retriever's responses (key, response VARIANT): a list, or one under the usual names.

    A text is an id of its own. An object's id stands under one of five keys, in it, in its metadata or in a nested document; its
    score under one of four, else 0. A response without a list is an error.
    """
    v, x = F.col("response"), F.col("x")
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("results", "hits", "matches", "documents", "data")]
    none = F.raise_error(F.lit("a retriever's response must be a list or hold one"))
    items = F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.coalesce(*lists, none))
    keys = ("chunk_id", "doc_id", "id", "document_id", "source_id")
    nested = [f"{p}{k}" for p in ("", "metadata.", "document.", "document.metadata.") for k in keys]
    ident = F.when(_kind(x).startswith("OBJECT"), F.coalesce(*[F.nullif(_blank(path_value(x, p)), F.lit("")) for p in nested])).when(_kind(x) == "STRING", _text(x))
    raw = F.coalesce(*[F.try_variant_get(x, f"$.{k}", "string") for k in ("score", "similarity", "_score", "relevance")])
    return responses.select("key", F.posexplode(items).alias("place", "x")).select("key", "place", ident.alias("id"), F.coalesce(raw.try_cast("double"), F.lit(0.0)).alias("score")).where("id is not null")
