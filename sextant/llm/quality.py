"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words in lower case, n-grams of their letters, n-grams of character shapes (upper, lower, digit, other
signs as they are; runs shortened) and marks for words that repeat one just before. The three blocks weigh
``WEIGHTS``; inverse document frequencies cover all documents. TF-IDF vectors of
a bounded labelled sample give the space (a truncated singular value
decomposition); its vectors are broadcast, and every document's cosines with
all of them are computed in blocks. The nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .features import bounded, code_points, document_frequencies, grams, is_letter, labelled_keys, remainder
from .token_counts import small

BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
LOWER, UPPER, DIGIT = 1, 2, 3
REPEATS = (BUCKETS, BUCKETS + 1, BUCKETS + 2)  # words, words like the one before, words like the one before that
LETTERS = BUCKETS + 3  # where n-grams of letters begin
WORDS = LETTERS + BUCKETS // 2  # where words begin
TERMS = WORDS + BUCKETS // 2
BLOCKS = (slice(0, LETTERS), slice(LETTERS, WORDS), slice(WORDS, TERMS))
WEIGHTS = (1.0, 0.3, 0.3)  # of shapes, letters, words


def letters_only(low: np.ndarray, letter: np.ndarray) -> str:
    """The letters and white space of code points."""
    space = ((low >= 9) & (low <= 13)) | ((low >= 28) & (low <= 32)) | (low == 0x85) | (low == 0xA0)
    for c in np.unique(low[(low > 0xA0) & ~letter]).tolist():
        if chr(c).isspace():
            space |= low == c
    return low[letter | space].tobytes().decode("utf-32-le", "surrogatepass")


def text_terms(text: str | None) -> np.ndarray:
    """Counts of the terms of a whole text; all zero for an empty or null one."""
    out = np.zeros(TERMS)
    if not text:
        return out
    cp = code_points(text)
    low = code_points(text.lower())
    letter = is_letter(cp)
    upper = (cp != low[: len(cp)]) if len(low) == len(cp) else np.frombuffer(bytes(c.isupper() for c in text), dtype=bool)
    shape = np.where(letter, np.where(upper, UPPER, LOWER), np.where((cp >= 48) & (cp <= 57), DIGIT, cp)).astype(np.int64)
    keep = np.ones(len(shape), bool)
    keep[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])  # runs count as two
    out[:BUCKETS] = np.bincount(grams(shape[keep], ORDERS, BUCKETS), minlength=BUCKETS)
    words = text.split()
    half = BUCKETS // 2
    letter = is_letter(low)
    plain = Counter(letters_only(low, letter).split())
    low = np.where(letter, low, 32).astype(np.int64)
    out[LETTERS:WORDS] = np.bincount(grams(low, (3,), half), minlength=half)
    at = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % half for w in plain), dtype=np.int64, count=len(plain))
    out[WORDS:] = np.bincount(at, np.fromiter(plain.values(), dtype=np.float64, count=len(plain)), minlength=half)
    out[REPEATS[0]] = len(words)
    out[REPEATS[1]] = 20 * sum(map(eq, words[1:], words))
    out[REPEATS[2]] = 20 * sum(map(eq, words[2:], words))
    return out


@dataclass
class NeighbourModel:
    idf: np.ndarray
    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, unit length
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """TF-IDF rows; each block has its weight as length, or is empty."""
        x = np.empty(counts.shape, np.float32)
        for block, weight in zip(BLOCKS, WEIGHTS, strict=True):
            own = counts[:, block]
            y = own / np.maximum(own[:, :BUCKETS].sum(axis=1, keepdims=True), 1) * 1_000
            y = np.log1p(y, out=y, where=y > 0) * self.idf[block]
            x[:, block] = weight * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return x

    def place(self, counts: np.ndarray) -> np.ndarray:
        q = (self.weigh(counts) @ self.basis).astype(np.float64)
        return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1; the prior for a text without terms.

        All labelled rows as near as the last neighbour vote, so equal similarities need no order.
        """
        empty = counts.sum(axis=1) == 0
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = self.place(counts) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        last = np.partition(cosine, -k, axis=1)[:, -k]
        row, near = np.nonzero(cosine >= last[:, None] - 1e-9)
        w = np.maximum(cosine[row, near], 1e-6) ** self.sharpness
        s = np.bincount(row, w * self.labels[near], len(counts)) / np.bincount(row, w, len(counts))
        return np.where(empty, self.prior, np.clip(s, 0, 1))


def fit(counts: np.ndarray, labels: np.ndarray, prior: float, df: np.ndarray, documents: int, *, rank: int = 48, neighbours: int = 15, sharpness: float = 8.0, seed: int = 3) -> NeighbourModel:
    """A model of labelled term counts and the terms' document frequencies."""
    model = NeighbourModel((np.log((1 + documents) / (1 + df)) + 1).astype(np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1)), labels, prior, neighbours, sharpness)
    if not len(labels):
        return model
    x = model.weigh(counts)
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 8, len(x)))))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    model.basis = vt[:rank].T.astype(np.float32)
    model.vectors = model.place(counts)
    return model


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1_500) -> NeighbourModel:
    """Fit on at most about ``per_class`` labelled documents a class that are not held out (crc32 of doc_id mod 5 is not 0).

    Rows without a doc_id have no label. A doc_id with several labels has the smallest; all its texts have it.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    df, documents = document_frequencies(texts.select("text"), lambda t: np.flatnonzero(text_terms(t)) if t else None, TERMS)
    able = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(remainder("doc_id", 5) != 0)
    prior = able.agg(F.avg("quality")).first()[0]
    chosen = F.broadcast(labelled_keys(able, "doc_id", "quality", per_class))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            terms = [text_terms(t) for t in b.column(1).to_pylist()]
            at = [np.flatnonzero(x) for x in terms]
            cols = [b.column(0), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<f4").tobytes() for x, a in zip(terms, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["quality", "at", "n"])

    rows = bounded(texts.join(chosen, "doc_id"), "quality", 2 * per_class).select("quality", "text").mapInArrow(tidy(gather), "quality int, at binary, n binary").collect()
    rows = sorted((r.quality, bytes(r.at), bytes(r.n)) for r in rows)
    counts = np.zeros((len(rows), TERMS), np.float32)
    for k, (_, at, n) in enumerate(rows):
        counts[k, np.frombuffer(at, "<i4")] = np.frombuffer(n, "<f4")
    return fit(counts, np.asarray([r[0] for r in rows], dtype=np.float64), 0.5 if prior is None else float(prior), df, documents)


def score(docs: DataFrame, model: NeighbourModel, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    An empty or null text scores the prior (label 1's share among the learned ones, a half without any). Repeated rows and
    rows without a doc_id (not held out) come out as they came in; texts of any length are read
    whole, other columns are not read, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small(batches, 128):
            s = m.scores(np.stack([text_terms(t) for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 1_500, threshold: float = 0.3) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``; see ``train`` and ``score``."""
    return score(docs, train(docs, labels, per_class=per_class), threshold=threshold)
