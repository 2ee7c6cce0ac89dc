"""Language identification: sparse multinomial logistic regression.

Texts are TF-IDF vectors of hashed character n-grams (orders 1 to 3 over letters in
lower case, everything else a gap). Weights are learned by
follow-the-regularised-leader with an elastic-net penalty, then one temperature is
fitted on a part of the sample that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, tidy
from .features import code_points, document_frequencies, grams, is_letter, labelled_rows, remainder
from .token_counts import small

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)


def text_grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a whole text; None where it is null or has no letter."""
    if not text:
        return None
    cp = code_points(text.lower())
    letter = is_letter(cp)
    if not letter.any():
        return None
    cp = np.where(letter, cp, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a gap only the first character
    cp = np.concatenate([[32], cp[keep], [32]])
    n = np.bincount(grams(cp, ORDERS, BUCKETS), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class LanguageModel:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        g = text_grams(text)
        if g is None or not self.classes:
            return "und", 0.0
        p = _softmax(self.logits(*g) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(min(1.0, max(0.0, p[k])))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, documents: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, calibration: float = 0.2, seed: int = 5) -> LanguageModel:
    """A model from (language, buckets, counts) rows and the buckets' document frequencies."""
    classes = sorted({r[0] for r in rows})
    model = LanguageModel(classes, np.log((1 + documents) / (1 + df)) + 1, np.zeros((BUCKETS, len(classes))), np.zeros(len(classes)), 1.0)
    if not classes:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = int(len(rows) * calibration) if len(rows) >= 50 else 0
    held_rows, train = order[:held], order[held:]
    z, n2 = np.zeros((BUCKETS + 1, len(classes))), np.zeros((BUCKETS + 1, len(classes)))
    index = {c: k for k, c in enumerate(classes)}

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n2[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(train):
            lang, at, n = rows[i]
            x = np.append(model.vector(at, n), 1.0)
            at = np.append(at, BUCKETS)
            w = weights(at)
            p = _softmax(x @ w)
            p[index[lang]] -= 1.0
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / alpha * w
            n2[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:-1], w[-1]
    if held:
        logits = np.stack([model.logits(*rows[i][1:]) for i in held_rows])
        truth = np.asarray([index[rows[i][0]] for i in held_rows])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(held), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def _terms(text: str | None) -> np.ndarray | None:
    found = text_grams(text)
    return None if found is None else found[0]


def train(docs: DataFrame, *, per_class: int = 1_500) -> LanguageModel:
    """Learn from rows with a language of their own that are not held out (crc32 of doc_id mod 4 is not 2).

    Document frequencies cover all of them; weights are fitted on at most ``per_class`` rows a language (30,000 in all)
    with a letter, chosen by a hash of id and text.
    """
    able = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    able = able.where(F.col("lang").isNotNull())
    df, documents = document_frequencies(able.select("text"), _terms, BUCKETS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [(lang, g) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (g := text_grams(t)) is not None]
            cols = [pa.array([x[0] for x in found], pa.string()), *(pa.array([x[1][k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "at", "n"])

    rows = labelled_rows(able, "lang", per_class).select("lang", "text").mapInArrow(tidy(gather), "lang string, at binary, n binary").collect()
    rows = sorted((r.lang, bytes(r.at), bytes(r.n)) for r in rows)
    return fit([(x, np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(n, "<i4").astype(np.float64)) for x, a, n in rows], df, documents)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language could be learned. A null doc_id is not held out. Repeated rows come out as often as
    they came in, of equally likely languages the first by name wins, texts of any length are read whole,
    other columns are not read, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small(batches):
            out = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, *, score: float, per_class: int = 1_500) -> DataFrame:
    """Rows of ``docs``, all columns kept, whose text has a language of at least ``score``; no shuffle.

    Each row is judged by itself, repeated and null doc_ids included; ``und`` goes. Other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_class=per_class))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small(batches):
            found = [m.predict(t) for t in b.column(text).to_pylist()]
            yield b.filter(pa.array([lang != "und" and p >= score for lang, p in found], pa.bool_()))

    return map_rows(docs, tidy(run))


def identify_languages(docs: DataFrame, *, per_class: int = 1_500) -> DataFrame:
    """Train on ``docs`` and predict all of them; see ``train`` and ``predict``."""
    return predict(docs, train(docs, per_class=per_class))
