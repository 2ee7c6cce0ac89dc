"""A retriever behind HTTP as a source of rankings, and the log of its calls."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spans import retriever_results

CALL = "key string, query_sha256 string, query_chars int, k int, status_code int, latency_ms double, body string, error string"


def parse_headers(values: list[str] | None) -> dict[str, str]:
    """'Name: value' arguments; anything else is an error."""
    out = {}
    for v in values or []:
        name, sign, value = v.partition(":")
        if not sign or not name.strip() or not value.strip():
            raise ValueError(f"a header must be `Name: value`, not `{v}`")
        out[name.strip()] = value.strip()
    return out


def ask(queries: DataFrame, url: str, *, k: int = 10, headers: dict[str, str] | None = None, timeout: float = 10.0) -> DataFrame:
    """CALL rows of queries (key, query): a POST of {query, k} each. A row has a text's hash and length, never the text."""
    sent = {"Content-Type": "application/json", **(headers or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                began, status, body, error = time.perf_counter(), None, None, None
                try:
                    request = urllib.request.Request(url, json.dumps({"query": text, "k": k}).encode(), sent, method="POST")
                    with urllib.request.urlopen(request, timeout=timeout) as got:
                        status, body = got.status, got.read().decode("utf-8")
                        json.loads(body)
                except (OSError, ValueError) as e:
                    status, error = getattr(e, "code", status), f"{type(e).__name__}: {e}"
                rows.append((key, hashlib.sha256((text or "").encode()).hexdigest(), len(text or ""), k, status, round(1_000 * (time.perf_counter() - began), 3), body, error))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in CALL.split(", ")])

    return queries.select(F.col("key").cast("string"), F.col("query").cast("string")).mapInArrow(run, CALL)


def rankings(calls: DataFrame) -> DataFrame:
    """(key, rank, id, score) of calls; a call that failed is an error."""
    body = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("retriever call failed: "), "error"))).otherwise(F.col("body"))
    found = retriever_results(calls.select("key", F.parse_json(body).alias("response")))
    return found.select("key", (F.col("place") + 1).cast("long").alias("rank"), "id", "score")


def call_log(calls: DataFrame) -> DataFrame:
    """What is kept of calls: hashes, sizes, times, ids and errors."""
    good = calls.where("error is null").select("key", F.parse_json("body").alias("response"))
    ids = retriever_results(good).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("result_ids"))
    return calls.drop("body").join(ids, "key", "left").withColumn("result_ids", F.coalesce("result_ids", F.array().cast("array<string>")))
