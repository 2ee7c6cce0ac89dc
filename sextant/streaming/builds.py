"""Claims that arrive as a stream, merged into builds batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.knowledge import merge_claims
from ..sources.store import BuildStore


def ingest(stream: DataFrame, root: str, checkpoint: str, *, buckets: int = 64, **merging) -> StreamingQuery:
    """Merge each batch of claims into the store at ``root``: one build a batch with new claims, its pages and vectors with it.

    Claims have the columns of ``merge_claims``, whose options ``merging`` takes; a missing ord is taken from the order of the batch's
    claim ids. State is the store, not the operator's: a batch that is done again after a failure adds nothing, since its claims are there.
    """

    def one(batch: DataFrame, _: int) -> None:
        rows = batch if "ord" in batch.columns else batch.withColumn("ord", F.xxhash64("claim_id"))
        merge_claims(BuildStore(batch.sparkSession, root, buckets=buckets), rows, **merging)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
