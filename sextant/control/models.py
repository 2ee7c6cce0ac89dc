"""Models and retrievers of the user's own, as columns and frames.

A factory makes the model, in each Python worker once; it must pickle. Models see lists of texts, of at most ``batch`` at
a time, and are never called for a null.

    Embedder    dim: int; embed_batch(texts) -> vectors of that many numbers
    Generator   generate_batch(prompts) -> (text, tokens) of each
    Scorer      score_batch(pairs of query and text) -> numbers
    Retriever   query(text, k) -> (id, score) of the best, in order
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MADE: dict[str, Any] = {}


class Embedder(Protocol):
    dim: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate_batch(self, prompts: list[str]) -> list[tuple[str, int]]: ...


class Scorer(Protocol):
    def score_batch(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Retriever(Protocol):
    def query(self, text: str, k: int) -> list[tuple[str, float]]: ...


def _model(name: str, factory: Callable[[], Any]) -> Any:
    """The worker's own model: made by the first batch that needs it, kept for later tasks."""
    if name not in _MADE:
        _MADE[name] = factory()
    return _MADE[name]


def _in_batches(rows: list, batch: int, ask: Callable[[list], list], what: str) -> list:
    """``ask`` of the rows that aren't null; one answer a row, else an error."""
    at = [i for i, r in enumerate(rows) if r is not None]
    out: list = [None] * len(rows)
    for lo in range(0, len(at), batch):
        part = at[lo : lo + batch]
        got = list(ask([rows[i] for i in part]))
        if len(got) != len(part):
            raise ValueError(f"{what} gave {len(got)} answers to {len(part)} texts")
        for i, x in zip(part, got, strict=True):
            out[i] = x
    return out


def embedder(factory: Callable[[], Embedder], *, batch: int = 100) -> Callable[[Column], Column]:
    """text column -> array<double>; a vector of another length than the model says is an error."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(name, factory)
        for s in batches:
            got = _in_batches(s.tolist(), batch, model.embed_batch, "the embedder")
            if any(v is not None and len(v) != model.dim for v in got):
                raise ValueError(f"the embedder gave a vector that isn't of {model.dim} numbers")
            yield pd.Series([None if v is None else [float(x) for x in v] for v in got], dtype=object)

    return lambda text: run(text)


def generator(factory: Callable[[], Generator], *, batch: int = 100) -> Callable[[Column], Column]:
    """prompt column -> struct<text, tokens>."""
    name = uuid.uuid4().hex

    @F.pandas_udf("text string, tokens long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(name, factory)
        for s in batches:
            got = _in_batches(s.tolist(), batch, model.generate_batch, "the generator")
            yield pd.DataFrame({"text": pd.Series([g and g[0] for g in got], dtype=object), "tokens": pd.Series([g and int(g[1]) for g in got], dtype="Int64")})

    return lambda prompt: run(prompt)


def texts_of(generate: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A generator's texts without its counts."""
    return lambda prompt: generate(prompt)["text"]


def scorer(factory: Callable[[], Scorer], *, batch: int = 100) -> Callable[[Column, Column], Column]:
    """(query column, text column) -> double."""
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(name, factory)
        for q, t in batches:
            pairs = [None if a is None or b is None else (a, b) for a, b in zip(q.tolist(), t.tolist(), strict=True)]
            yield pd.Series(_in_batches(pairs, batch, model.score_batch, "the scorer"), dtype="float64")

    return lambda query, text: run(query, text)


def retrieved(queries: DataFrame, factory: Callable[[], Retriever], out: str, *, k: int = 10) -> DataFrame:
    """(key, rank, id, score) of queries (key, query), asked of a retriever and written to ``out``, then read from there.

    Whatever is done with the result, nothing is asked again. A query that is null finds nothing; of equal ids the first counts; results
    beyond k are left out.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, factory)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen: dict[str, float] = {}
                for ident, score in model.query(text, k) if text is not None else []:
                    seen.setdefault(ident, score)
                rows += [(key, i + 1, ident, float(s)) for i, (ident, s) in enumerate([*seen.items()][:k])]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["key", "rank", "id", "score"])

    asked = queries.select(F.col("key").cast("string").alias("key"), F.col("query").cast("string").alias("query"))
    schema = "key string, rank long, id string, score double"
    asked.mapInArrow(run, schema).write.parquet(out)
    return queries.sparkSession.read.schema(schema).parquet(out)
