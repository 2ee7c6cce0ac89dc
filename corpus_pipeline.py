"""Documents to packed training sequences, by five operators of sextant.llm.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents. A row
is judged by itself: null and repeated doc_ids are no reason to go, an empty table passes every stage. Extra columns
of any name and type come along to the last stage, which doesn't read them; very long texts are read whole. Of equally
similar rows that of the smallest doc_id stays, then one by a hash of the row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import by_name, row_hash, small_batches, spill, unspill
from sextant.llm.decontam import contaminated
from sextant.llm.jaccard import keep_one
from sextant.llm.langid import keep_identified
from sextant.llm.packing import pack_documents
from sextant.llm.suffixes import remove_repeats

MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of a half or more; those without a letter go."""
    small_batches(spark)
    return keep_identified(docs, score=MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each class of similar texts (five words, 0.8)."""
    return keep_one(spark, docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that come more than once; documents of which nothing is left go."""
    small_batches(spark)
    cut = remove_repeats(spark, docs)
    return cut.where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*by_name(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of one doc_id are judged apart."""
    row, hit = row_hash(docs), f"_hit_{uuid.uuid4().hex}"
    hits = contaminated(spark, docs.select(row.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = spill(spark, hits.select(F.col("doc_id").alias(hit)).distinct())
    return docs.join(hits, row == F.col(hit), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences."""
    small_batches(spark)
    return pack_documents(spark, docs)


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("suffix_dedup", repeated_passages), ("decontamination", decontaminate), ("packing", packing)]

#: SQL can't express the first stage; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, spill(spark, stage(spark, docs, sf_dir))
        unspill(before)
    return docs
