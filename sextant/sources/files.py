"""Readers and writers of corpora, questions, traces, manifests and builds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import corpus_records, trace_records

QUESTION = "id STRING, tier STRING, question STRING, ground_truth_answer STRING, ground_truth_citations ARRAY<STRING>, must_include_terms ARRAY<STRING>, must_not_include_terms ARRAY<STRING>, notes STRING, corpus_id STRING, facets ARRAY<STRING>, unanswerable BOOLEAN, expected_abstain BOOLEAN, distractor_citations ARRAY<STRING>, temporal_anchor STRING, authored_by STRING, verified_by STRING"


class ManifestError(RuntimeError):
    """A manifest is missing, stale or malformed."""


class BudgetExceeded(RuntimeError):
    """A run would cost or ask more than it may."""


def read_documents(spark: SparkSession, globs: list[str], root: str = "") -> DataFrame:
    """(source_path, text, doc_ord) of text files under ``root``; a file counts for its first glob, files that are not UTF-8 are left out.

    Paths are relative to the root. doc_ord orders documents by glob, then path.
    """
    base = root.rstrip("/") + "/" if root else ""
    parts = [spark.read.format("binaryFile").load(base + g).select("path", "content", F.lit(i).alias("g")) for i, g in enumerate(globs)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.is_valid_utf8(F.col("content").cast("string"))).groupBy("path").agg(F.min("g").alias("g"), F.min(F.col("content").cast("string")).alias("text"))
    path = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    if base.startswith("/"):
        path = F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
    return rows.select(path.alias("source_path"), "text", F.struct("g", path.alias("path")).alias("doc_ord"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(row VARIANT, ord) of a JSON-lines file; blank lines are skipped, others that are no JSON fail."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return lines.where(F.trim("value") != "").select(F.parse_json("value").alias("row"), "ord")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus_records(read_jsonl(spark, path))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return trace_records(read_jsonl(spark, path))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSONL file with ``ord``, their order; blank lines and lines opening with // are skipped."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    rows = lines.select(F.from_json("value", QUESTION, {"mode": "FAILFAST"}).alias("q"), "ord").select("q.*", "ord")
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("ground_truth_citations", "must_include_terms", "must_not_include_terms")} | {"unanswerable": F.coalesce("unanswerable", F.lit(False))})


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(row VARIANT, ord) of an export that is one JSON document, an array, or JSON lines; items that are no objects are dropped.

    Lines are read as lines: only a file whose first line is no JSON by itself, or is an array, is read whole.
    """
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(F.trim("value") != "")
    first = lines.orderBy("ord").select(F.schema_of_variant(F.try_parse_json("value")).alias("k")).first()
    if first is not None and (first.k is None or first.k.startswith("ARRAY")):
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
        rows = whole.where("v is not null").select(F.posexplode(items).alias("ord", "row")).select("row", F.col("ord").cast("long").alias("ord"))
    else:
        rows = lines.select(F.try_parse_json("value").alias("row"), "ord")
    return rows.where(F.schema_of_variant("row").startswith("OBJECT"))


def write_traces(rows: DataFrame, path: str) -> int:
    """Write normalised trace rows as JSON lines; the number written. A need that is null is left out."""
    out = rows.drop("ord")
    out.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return out.sparkSession.read.text(path).count()


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) of a predicate vocabulary in YAML: {predicates: [{name, aliases}]}; a name is its own alias."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = (yaml.safe_load(f) or {}).get("predicates") or []
    rows = sorted({(a.lower(), p["name"]) for p in found for a in [p["name"], *(p.get("aliases") or [])]})
    return spark.createDataFrame(rows, "alias string, canonical string")


def write_manifest(spark: SparkSession, root: str, adapter: str, corpus_hash: str, mapping: dict[str, str]) -> None:
    rows = [(adapter, corpus_hash, k, v) for k, v in sorted(mapping.items())]
    spark.createDataFrame(rows, "adapter STRING, corpus_hash STRING, provider_id STRING, source_path STRING").write.mode("overwrite").json(f"{root}/{adapter}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_manifest(spark: SparkSession, root: str, adapter: str, corpus_hash: str) -> DataFrame:
    """The manifest of an adapter, or an error if it isn't for this corpus."""
    path = f"{root}/{adapter}"
    if not exists(spark, path):
        raise ManifestError(f"no manifest for {adapter}")
    rows = spark.read.schema("adapter STRING, corpus_hash STRING, provider_id STRING, source_path STRING").json(path)
    stale = rows.where(F.coalesce(F.col("corpus_hash") != corpus_hash, F.lit(True)) | F.col("provider_id").isNull()).limit(1).collect()
    if stale or not rows.limit(1).collect():
        raise ManifestError(f"the manifest for {adapter} is stale or malformed")
    return rows.select("provider_id", "source_path")


def resolve_sources(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add source_path: the manifest's entry, else the first entry of equal base name, else the id itself."""
    base = lambda c: F.substring_index(c, "/", -1)
    exact = manifest.select("provider_id", F.col("source_path").alias("_exact"))
    named = manifest.groupBy(base("source_path").alias("_base")).agg(F.min_by("source_path", "provider_id").alias("_named"))
    return ids.join(exact, "provider_id", "left").join(named, base("provider_id") == F.col("_base"), "left").withColumn("source_path", F.coalesce("_exact", "_named", "provider_id")).drop("_exact", "_named", "_base")


def preflight(estimate_usd: float, n_queries: int, *, cap_usd: float = 20.0, query_cap: int = 50) -> None:
    if estimate_usd > cap_usd or n_queries > query_cap:
        raise BudgetExceeded(json.dumps({"usd": estimate_usd, "queries": n_queries}))


def build_chain(spark: SparkSession, builds: DataFrame, head: str) -> DataFrame:
    """(build_id, depth) from the head back over parents."""
    return spark.sql("WITH RECURSIVE chain(build_id, parent, depth) AS (SELECT build_id, parent_build_id, 0 FROM {builds} WHERE build_id = :head UNION ALL SELECT b.build_id, b.parent_build_id, c.depth + 1 FROM {builds} b JOIN chain c ON b.build_id = c.parent) SELECT build_id, cast(depth AS BIGINT) AS depth FROM chain", args={"head": head}, builds=builds)
