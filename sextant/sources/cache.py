"""Answers of text models kept by the content of what was asked, so that a model is asked once a key.

A cache is a folder of (cache_key, value) rows, in partitions of the key's first two digits. Each fill writes a folder of its own there,
straight from the tasks that ask: what a task has written stays written if an executor is lost later, and nobody's
write touches another's. A key that two fills have counts with its earliest answer.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import names_in

ROW = "cache_key string, value string, at long"


def cache_key(version: Column, model: Column, prompt: Column, chunk: Column) -> Column:
    """The name of a cached extraction or summary."""
    return F.sha2(F.concat_ws("\n", version, model, prompt, chunk).cast("binary"), 256)


class TextCache:
    """The cache in the folder ``root``, which all executors must share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def rows(self, prefixes: list[str] | None = None) -> DataFrame:
        """(cache_key, value, at) of all fills, of one that broke off what its tasks have finished; of some prefixes only if given."""
        fills = [f"{self.root}/{n}" for n in names_in(self.spark, self.root) if n.startswith("fill=")]
        if not fills:
            return self.spark.createDataFrame([], ROW)
        found = self.spark.read.schema(ROW + ", fill string, prefix string").option("basePath", self.root).parquet(*fills)
        return (found if prefixes is None else found.where(F.col("prefix").isin(prefixes))).select("cache_key", "value", "at")

    def values(self, prefixes: list[str] | None = None) -> DataFrame:
        """(cache_key, value), one row a key."""
        return self.rows(prefixes).groupBy("cache_key").agg(F.min_by("value", F.struct("at", "value")).alias("value"))

    def prefixes_of(self, asks: DataFrame) -> list[str]:
        """The partitions of some keys: 256 at most."""
        return sorted(r[0] for r in asks.select(F.substring("cache_key", 1, 2).alias("p")).distinct().collect())

    def fill(self, asks: DataFrame, generate: Callable[[Column], Column], *, prefixes: list[str] | None = None) -> str | None:
        """Ask for the keys of ``asks`` (cache_key, prompt) that have no value yet, each once; the folder written, if any was.

        A null prompt is asked as ''. ``generate`` maps the prompt column to texts.
        """
        prefixes = self.prefixes_of(asks) if prefixes is None else prefixes
        keyed = asks.select("cache_key", F.coalesce("prompt", F.lit("")).alias("prompt")).groupBy("cache_key").agg(F.min("prompt").alias("prompt"))
        missing = keyed.join(self.rows(prefixes).select("cache_key").distinct(), "cache_key", "left_anti")
        if missing.isEmpty():
            return None
        where = f"{self.root}/fill={uuid.uuid4().hex}"
        # Dealt by key first, so that nothing is shuffled after it was asked.
        dealt = missing.withColumn("prefix", F.substring("cache_key", 1, 2)).repartition("prefix", "cache_key")
        made = dealt.select("cache_key", generate(F.col("prompt")).alias("value"), F.lit(time.time_ns()).alias("at"), "prefix")
        made.write.partitionBy("prefix").parquet(where)
        return where

    def through(self, rows: DataFrame, key: Column, prompt: Column, generate: Callable[[Column], Column], *, into: str = "value") -> DataFrame:
        """``rows`` with the model's text for each in the column ``into``, asked for now or before.

        Rows are those that came in: equal ones share an answer. Any columns they have stay as they are, but one named like ``into``.
        """
        own = f"_{uuid.uuid4().hex}"
        keyed = rows.withColumn(own, key)
        asks = keyed.select(F.col(own).alias("cache_key"), prompt.alias("prompt"))
        prefixes = self.prefixes_of(asks)
        self.fill(asks, generate, prefixes=prefixes)
        found = self.values(prefixes).select(F.col("cache_key").alias(own), F.col("value").alias(f"{own}v"))
        kept = [F.col(f"`{c}`") for c in rows.columns if c != into]
        return keyed.join(found, own, "left").select(*kept, F.col(f"{own}v").alias(into))
