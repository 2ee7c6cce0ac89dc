"""Systems: what answers all questions from a corpus of chunks, set by set.

A system is a function of chunks (doc, ord, source_path, text), questions and a ``Context`` that gives answers (evaluation.ANSWER). The
models behind them are columns, mock ones unless others are given; ``control.models`` makes such columns of a user's classes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cap_words, hashed_buckets, padded_text, tokens
from ..operators import claims as C
from ..operators import evaluation as E
from ..operators import knowledge as K
from ..operators import ranking as R
from ..sources.cache import TextCache, cache_key

MOCK_DIM = 64
EXTRACTION, SUMMARY = "claims-1", "summary-1"
#: What systems say that have nothing indexed, by the reason they give.
EMPTY = {"empty_claim_index": "(no claims extracted from corpus; system cannot answer)", "empty_page_index": "(no entity pages projected from corpus; system cannot answer)", "empty_chunk_index": "(no chunks loaded; system cannot answer)"}


def mock_embed(text: Column) -> Column:
    """Counts of a text's hashed words and word pairs as a vector; a bucket is a letter, and a count what a text loses without it."""
    letters = F.array_join(F.transform(hashed_buckets(text, MOCK_DIM), lambda b: F.char(b + 48)), "")
    lost = lambda s, b: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(chr(b + 48)), F.lit("")))
    return F.transform(F.array(letters), lambda s: F.array(*[lost(s, b).cast("double") for b in range(MOCK_DIM)]))[0]


def mock_score(query: Column, text: Column) -> Column:
    """The share of a query's words that a text has."""
    q = tokens(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(F.array_distinct(q))), F.lit(0.0)).cast("double")


@dataclass(frozen=True)
class Models:
    """embed: text -> vector; generate: prompt -> struct<text, tokens>; extract, summarise: text -> text; score: (query, text) -> number.

    ``name`` stands for the models in the names of cached texts.
    """

    embed: Callable[[Column], Column] = mock_embed
    generate: Callable[[Column], Column] = E.mock_answer
    extract: Callable[[Column], Column] = lambda text: text
    summarise: Callable[[Column], Column] = lambda text: cap_words(text, 40)
    score: Callable[[Column, Column], Column] = mock_score
    name: str = "mock"


@dataclass(frozen=True)
class Context:
    """What systems run with. ``folder`` takes what models were asked for, so that it is asked once; without one it may be asked again."""

    models: Models = field(default_factory=Models)
    k: int = 5
    folder: str | None = None
    cache: TextCache | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        if self.folder is None:
            return df
        where = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(where)
        return df.sparkSession.read.schema(df.schema).parquet(where)

    def said(self, chunks: DataFrame, what: str, ask: Callable[[Column], Column], into: str) -> DataFrame:
        """Chunks with a model's text for each, from the cache if there is one."""
        if self.cache is None:
            return self.keep(chunks.withColumn(into, ask(F.col("text"))))
        key = cache_key(F.lit(what), F.lit(self.models.name), F.lit(""), F.col("text"))
        return self.cache.through(chunks, key, F.col("text"), ask, into=into)


System = Callable[[DataFrame, DataFrame, Context], DataFrame]


def asked(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("id").alias("qid"), F.col("question").alias("query"))


def embedded(df: DataFrame, text: str, ident: list[str], embed: Callable[[Column], Column]) -> DataFrame:
    return df.select(*ident, embed(F.col(text)).alias("vec"))


def _dense(docs: DataFrame, questions: DataFrame, cx: Context, k: int) -> DataFrame:
    vectors = cx.keep(embedded(docs, "text", ["doc", "ord"], cx.models.embed))
    return R.dense_rank(vectors, cx.keep(embedded(asked(questions), "query", ["qid"], cx.models.embed)), k)


def _bm25(chunks: DataFrame, questions: DataFrame, cx: Context) -> DataFrame:
    return R.bm25_rank(chunks, asked(questions), cx.k)


def _hybrid(chunks: DataFrame, questions: DataFrame, cx: Context) -> DataFrame:
    return R.fuse(_dense(chunks, questions, cx, 20), R.bm25_rank(chunks, asked(questions), 20), cx.k)


def _padded(chunks: DataFrame, questions: DataFrame, cx: Context) -> DataFrame:
    return _dense(chunks.withColumn("text", padded_text(F.col("text"))), questions, cx, cx.k)


def _reranked(chunks: DataFrame, questions: DataFrame, cx: Context) -> DataFrame:
    """The 20 nearest chunks, scored anew; equal scores keep the first order."""
    pool = _dense(chunks, questions, cx, 20).join(chunks.select("doc", "text"), "doc").join(R.small(asked(questions)), "qid")
    pool = cx.keep(pool.withColumn("new", cx.models.score(F.col("query"), F.col("text"))))
    return R.rerank(pool, lambda _: F.col("new"), cx.k).select("qid", "doc", "ord", "score", "rank")


def _summarised(chunks: DataFrame, questions: DataFrame, cx: Context) -> DataFrame:
    """Chunks found by their summaries; a chunk with a blank one by its text."""
    said = cx.said(chunks, SUMMARY, cx.models.summarise, "summary")
    return _dense(said.withColumn("text", R.chunk_summary_text(F.col("summary"), F.col("text"))), questions, cx, cx.k)


RANKERS = {"bm25": _bm25, "dense": lambda c, q, cx: _dense(c, q, cx, cx.k), "hybrid": _hybrid, "termpad": _padded, "rerank": _reranked, "chunk_summary": _summarised}


def rank_by(name: str, chunks: DataFrame, questions: DataFrame, cx: Context) -> DataFrame:
    """(qid, doc, ord, score, rank) of one system for all questions."""
    return RANKERS[name](chunks, questions, cx)


def nothing(system: str, questions: DataFrame, reason: str) -> DataFrame:
    """The answers of a system that has nothing indexed: refusals."""
    none = F.array().cast(E.CITATIONS)
    rows = R.answers_of_empty_index(asked(questions), reason, EMPTY.get(reason, ""))
    return rows.select(F.lit(system).alias("system"), "qid", "answer", none.alias("citations"), none.alias("retrieved_sources"), none.alias("answer_citations"), F.lit(0.0).alias("latency_ms"), F.lit(None).cast("double").alias("retrieval_latency_ms"), F.lit(0).cast("long").alias("tokens_used"), "refused", "refusal_reason")


def ranked_system(name: str) -> System:
    """A system that answers from the chunks its ranking finds."""

    def run(chunks: DataFrame, questions: DataFrame, cx: Context) -> DataFrame:
        if name == "chunk_summary" and chunks.isEmpty():
            return nothing(name, questions, "empty_chunk_index")
        full = rank_by(name, chunks, questions, cx).join(chunks.select("doc", "source_path", "text"), "doc").withColumnRenamed("doc", "chunk_id")
        return E.answers_of(name, questions, full, cx.models.generate)

    return run


def extracted(chunks: DataFrame, cx: Context) -> DataFrame:
    """Claims (claim_id, kind, subject, predicate, object, object_kind, uris, ord, chunk_id) that the model finds in chunks."""
    said = cx.said(chunks.select(F.col("doc").alias("chunk_id"), "ord", "text"), EXTRACTION, cx.models.extract, "said")
    found = C.extracted_claims(said, lambda _: F.col("said"), EXTRACTION)
    return cx.keep(found.withColumn("kind", F.lit("entity:concept")).withColumn("object_kind", F.lit(None).cast("string")))


def claims_index(claims: DataFrame) -> DataFrame:
    """(doc, ord, text) of claims: what is embedded of them."""
    return claims.select(F.col("claim_id").alias("doc"), "ord", C.claim_text(F.col("subject"), F.col("predicate"), F.col("object")).alias("text"))


def claim_system(chunks: DataFrame, questions: DataFrame, cx: Context, *, k: int = 8) -> DataFrame:
    """Answers from the k claims nearest to a question; each source is cited once, by its first claim."""
    claims = extracted(chunks, cx)
    if claims.isEmpty():
        return nothing("claims", questions, "empty_claim_index")
    texts = claims_index(claims)
    ranked = _dense(texts, questions, cx, k).join(texts.select("doc", "text"), "doc").join(claims.select(F.col("claim_id").alias("doc"), "chunk_id"), "doc")
    ranked = ranked.withColumn("source_path", F.substring_index("chunk_id", "#", 1))
    context = R.context(ranked, head="[doc:{}] ", between="\n")
    return E.answers_from("claims", questions, context, R.first_citations(ranked, 240), cx.models.generate, detects_refusal=False)


def page_system(chunks: DataFrame, questions: DataFrame, cx: Context, *, k: int = 4) -> DataFrame:
    """Answers from the k entity pages nearest to a question; their evidence is cited, each source once."""
    pages = cx.keep(K.project(extracted(chunks, cx)))
    if pages.isEmpty():
        return nothing("pages", questions, "empty_page_index")
    texts = K.indexed_text(pages, 1, True).select(F.col("page_id").alias("doc"), "ord", "text")
    ranked = _dense(texts, questions, cx, k)
    return E.answers_from("pages", questions, K.page_context(ranked, pages), K.page_citations(ranked, pages), cx.models.generate, detects_refusal=False)


SYSTEMS: dict[str, System] = {n: ranked_system(n) for n in RANKERS} | {"claims": claim_system, "pages": page_system}
