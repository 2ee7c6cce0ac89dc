"""Content hashes that name claims, proof sets, pages, builds and corpora."""

from __future__ import annotations

import ctypes
import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources.store import workspace


def joined_hash(*parts: Column) -> Column:
    """sha256 of parts joined by a bar; a null part is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def _lines(values: Column) -> Column:
    return F.array_join(F.array_sort(values), "\n")


def claim_id(subject: Column, predicate: Column, obj: Column, prompt: Column, uris: Column) -> Column:
    return joined_hash(subject, predicate, obj, prompt, _lines(uris))


def proof_set_id(sources: Column) -> Column:
    return joined_hash(_lines(sources))


def acl_id(labels: Column) -> Column:
    return joined_hash(_lines(F.array_distinct(labels)))


def trace_id(query_hash: Column, principal_hash: Column, when: Column) -> Column:
    return joined_hash(query_hash, principal_hash, when)


def principal_id(principal: Column, salt: str) -> Column:
    if not salt:
        raise ValueError("salt must not be empty")
    return joined_hash(F.lit(salt), principal)


def page_id(kind: Column, subject: Column) -> Column:
    return joined_hash(kind, subject)


def build_id(parent: Column, new_claims: Column) -> Column:
    return joined_hash(F.coalesce(parent, F.lit("root")), F.array_join(F.array_sort(new_claims), "|"))


def strictest_region(regions: Column, order: tuple[str, ...] = ("public", "global", "us", "eu")) -> Column:
    """The most stringent of an array of regions; a region not in ``order`` beats all that are."""
    place = F.create_map(*[x for i, r in enumerate(order) for x in (F.lit(r), F.lit(i))])
    ranked = F.transform(regions, lambda r: F.struct((F.try_element_at(place, r).isNull()).cast("int").alias("free"), F.coalesce(F.lpad(F.try_element_at(place, r).cast("string"), 8, "0"), r).alias("key"), r.alias("r")))
    return F.when(F.size(regions) > 0, F.array_max(ranked)["r"]).otherwise(F.raise_error(F.lit("regions must not be empty")))


def common_labels(sets: Column) -> Column:
    """Labels that all sets of an array of arrays have, sorted."""
    return F.when(F.size(sets) > 0, F.array_sort(F.aggregate(F.slice(sets, 2, F.size(sets)), F.array_distinct(sets[0]), lambda a, b: F.array_intersect(a, b)))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Texts with composed characters; Spark has no such function."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def query_id(query: Column) -> Column:
    return joined_hash(nfc(query))


class Sha256:
    """SHA-256 whose state can be written down, to go on with in another task; hashlib's can't. The library is the one hashlib uses."""

    _SIZE = 112  # SHA256_CTX of OpenSSL: eight words of state, the length, a block and its fill; no pointers

    def __init__(self, state: bytes | None = None) -> None:
        import _hashlib

        self._lib = ctypes.CDLL(_hashlib.__file__)
        self._state = ctypes.create_string_buffer(state or b"", self._SIZE)
        if state is None:
            self._lib.SHA256_Init(self._state)

    @classmethod
    def usable(cls) -> bool:
        """Whether a digest in two steps is hashlib's here; other builds of Python may not give the functions."""
        try:
            first = cls()
            first.update(b"a" * 100)
            then = cls(first.state())
            then.update(b"b" * 100)
            return then.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()
        except (ImportError, OSError, AttributeError, ValueError):
            return False

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._state, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), self._SIZE)
        self._lib.SHA256_Final(out, last)
        return out.raw.hex()


def corpus_hash(chunks: DataFrame, *, size: int = 256 << 20) -> DataFrame:
    """One row (corpus_hash) over chunks (source_path, chunk_index, text), in the order of path and index.

    The digest is of all bytes in that order. They are sorted by Spark in ranges of about ``size`` bytes, which pass through a task each, one
    after the other, in pieces: a task begins with the state of the digest where the last one ended, some 100 bytes. Where the state
    can't be had (``Sha256.usable``) one task reads all ranges.
    """
    spark = chunks.sparkSession
    zero = F.unhex(F.lit("00"))
    piece = F.concat(F.col("source_path").cast("binary"), zero, F.col("chunk_index").cast("string").cast("binary"), zero, F.col("text").cast("binary"), F.unhex(F.lit("0A")))
    pieces = chunks.select("source_path", "chunk_index", piece.alias("p"))
    ranges = -(-(pieces.agg(F.sum(F.octet_length("p"))).first()[0] or 0) // size)

    def through(state: bytes | None, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = hashlib.sha256() if state is None and last else Sha256(state)
            for b in batches:
                for x in b.column(0):
                    h.update(x.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest() if last else h.state()])], ["corpus_hash"])

        return run

    if ranges < 2 or not Sha256.usable():
        return pieces.orderBy("source_path", "chunk_index").select("p").coalesce(1).mapInArrow(through(None, True), "corpus_hash string")
    at, state = f"{workspace(spark)}/pieces", None
    order = ["source_path", "chunk_index"]
    # Equal numbers of rows may differ in bytes, so ranges are cut finer and joined up to the size.
    fine = pieces.repartitionByRange(8 * ranges, *order).withColumn("range", F.spark_partition_id())
    fine.write.partitionBy("range").parquet(at)
    fine = spark.read.schema(StructType([*pieces.schema, StructField("range", IntegerType())])).parquet(at)
    groups, held = [], 0
    for row in fine.groupBy("range").agg(F.sum(F.octet_length("p")).alias("n")).orderBy("range").collect():
        if not groups or held + (row.n or 0) > size:
            groups.append([])
            held = 0
        groups[-1].append(row.range)
        held += row.n or 0
    for i, group in enumerate(groups):
        own = fine.where(F.col("range").isin(group)).coalesce(1).sortWithinPartitions("range", *order).select("p")
        if i + 1 == len(groups):
            return own.mapInArrow(through(state, True), "corpus_hash string")
        state = bytes(own.mapInArrow(through(state, False), "corpus_hash binary").first()[0])


def short_hash(full: Column) -> Column:
    """The first sixteen characters of a hash; an error if it has fewer."""
    return F.when(F.length(full) >= 16, F.substring(full, 1, 16)).otherwise(F.raise_error(F.concat(F.lit("hash too short to cut: "), full)))


def iso_time(c: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def from_iso(c: Column) -> Column:
    return F.to_timestamp(c)
