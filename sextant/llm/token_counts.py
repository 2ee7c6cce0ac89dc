"""Token counts with overlap resynchronisation of huge documents.

A text of more than ``chunk_chars`` characters is encoded in chunks that
overlap. A cut position is proven stable when both neighbouring chunks start a
pre-token there: cutting goes left to right and looks ahead by one character or
a special string, so whatever the left chunk cut before that is final, and from
a common start on both chunks cut alike. Tokens before the cut count from the
left chunk, the rest from the right one. Without a common start the overlap
is doubled, in the end to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import Encoder, encoder, vocabulary


def _starts(encoding, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Token starts, and the starts of pre-tokens but the first, in the text."""
    if not len(encoding):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.asarray([o[0] for o in encoding.offsets], dtype=np.int64) + shift
    word = np.asarray([-1 - i if w is None else w for i, w in enumerate(encoding.word_ids)], dtype=np.int64)
    new = np.flatnonzero(word[1:] != word[:-1]) + 1
    new = new[at[new] > at[new - 1]]
    return at, at[new]


def resync_count(tokenizer, text: str, chunk_chars: int, overlap: int) -> int:
    """Number of tokens of ``text``, from overlapping chunks spliced as above."""
    n = len(text)
    if n <= chunk_chars:
        return len(tokenizer.encode(text, add_special_tokens=False))
    ahead = 1 + max([len(t.content) for t in tokenizer.get_added_tokens_decoder().values()], default=0)
    overlap = ahead + max(1, overlap)
    lo, hi = 0, chunk_chars
    at, cuts = _starts(tokenizer.encode(text[:hi], add_special_tokens=False), 0)
    total, since = 0, 0  # tokens before the position ``since`` are counted
    while hi < n:
        wide = overlap
        while True:
            start = max(since, hi - wide)
            end = min(n, max(hi, start) + chunk_chars)
            right, its = _starts(tokenizer.encode(text[start:end], add_special_tokens=False), start)
            common = np.intersect1d(cuts, its)
            common = common[(common > since) & (common > start) & (common <= hi - ahead)]
            if len(common):
                break
            if start == since and end == n:  # nothing to align with: all of the rest at once
                return total + len(right)
            if start == since:
                # one pre-token fills the chunk: take a longer one from the last cut
                hi = min(n, hi + chunk_chars)
                at, cuts = _starts(tokenizer.encode(text[since:hi], add_special_tokens=False), since)
                if hi == n:
                    return total + len(at)
                continue
            wide *= 2
        cut = int(common[-1])
        total += int(np.count_nonzero((at >= since) & (at < cut)))
        since, at, cuts, lo, hi = cut, right, its, start, end
    return total + int(np.count_nonzero(at >= since))


def count_tokens(enc: Encoder, texts: list[str | None], chunk_chars: int, overlap: int) -> list[int]:
    """Token counts of texts; those above ``chunk_chars`` characters in chunks."""
    huge = [t is not None and len(t) > chunk_chars for t in texts]
    ids = enc.encode([None if h else t for t, h in zip(texts, huge, strict=True)])
    return [resync_count(enc.tokenizer, t, chunk_chars, overlap) if h else len(x) for t, h, x in zip(texts, huge, ids, strict=True)]


def token_counts(docs: DataFrame, *, vocab: str | None = None, chunk_chars: int = 32_768, overlap: int = 256, limit: int = 2_048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    A null or empty text has no bytes and no tokens. Repeated rows and null
    ids come out as they came in; other columns are not read.
    """
    path = vocab or vocabulary("word_bpe_49k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in small(batches):
            n = count_tokens(enc, b.column(1).to_pylist(), chunk_chars, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that their Python objects stay few."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
