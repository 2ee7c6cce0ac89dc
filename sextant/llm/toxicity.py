"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding decomposes characters, drops marks, lowers case and maps homoglyphs and digit or sign substitutions to plain
letters, in texts and lexicon alike. The lexicon is learned from a bounded labelled sample: words
and word beginnings that toxic texts have and clean ones lack beyond chance, weighted by
log odds. Phrases of two words with such a term that only clean texts have are exceptions. A text's hits, less
those inside an exception phrase, are summed and normalised by its length; a logistic curve over both turns them to a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .features import bounded, labelled_keys, remainder
from .token_counts import small

#: Characters and the letters they pass for, after decomposition.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ӏ": "i", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
_HIDDEN = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xAD, 0x2060, 0xFEFF))
_FOLD = str.maketrans({**HOMOGLYPHS, **SUBSTITUTES}) | _HIDDEN
_MARKS = regex.compile(r"\p{Mn}+")
_STROKES = regex.compile(r"(?<=[\p{L}\p{N}@$])[!|](?=[\p{L}\p{N}@$])")  # a sign inside a word
_WORD = regex.compile(r"[\p{L}\p{M}]+")
PREFIXES = (4, 5, 6, 7, 8)


def fold(text: str) -> str:
    """Lower case without marks, homoglyphs and substitutions as letters (l, 1, and ! or | inside a word are i)."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "!" in text or "|" in text:
        text = _STROKES.sub("i", text)
    return text.lower().translate(_FOLD)


@dataclass
class Lexicon:
    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for kind, terms in (("w", self.words), ("b", self.beginnings), ("e", dict.fromkeys(self.exceptions, 0.0))):
                for t, weight in terms.items():
                    entries.setdefault(t, []).append((kind, weight))
            for t, kinds in entries.items():
                a.add_word(t, (len(t), kinds))
            if entries:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str | None) -> tuple[float, int]:
        """(weight of the words that are hit, each once; words of the text)."""
        if not text:
            return 0.0, 0
        s = fold(text)
        n = s.count(" ") + s.count("\n") + 1
        a = self.automaton()
        if not len(a):
            return 0.0, n
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, kinds) in a.iter(s):
            start = end - size + 1
            if start and s[start - 1].isalpha():
                continue
            closed = end + 1 == len(s) or not s[end + 1].isalpha()
            for kind, weight in kinds:
                if kind == "e" and closed:
                    spared.append((start, end))
                elif kind == "b" or kind == "w" and closed:
                    found[start] = max(found.get(start, 0.0), weight)
        return sum(w for at, w in found.items() if not any(lo <= at <= hi for lo, hi in spared)), n

    def score(self, text: str | None) -> float:
        return self.curve_of(*self.hits(text))

    def curve_of(self, weight: float, n: int) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(weight) + c * np.log1p(100 * weight / max(n, 1)), -30, 30))))


def _surprise(toxic: Column, clean: Column, share: float) -> Column:
    """A bound of minus the log probability that chance gives so many toxic ones, if each of them is toxic with ``share``."""
    p = toxic / (toxic + clean)
    part = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(0.0)
    return F.when(p > share, (toxic + clean) * (part(p, share) + part(1 - p, 1 - share))).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 3_000, odds: float = 1.5, chance_terms: float = 0.5) -> Lexicon:
    """Learn from about ``per_class`` labelled documents a class that are not held out (crc32 of doc_id mod 3 is not 1).

    A term is kept if its log odds are ``odds`` or more and so many toxic texts have it that chance would let at most
    ``chance_terms`` of all terms pass. Rows without a doc_id have no label; a doc_id with several labels has the
    smallest, for all its texts. Without toxic rows the lexicon is empty.
    """
    able = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(remainder("doc_id", 3) != 1)
    chosen = F.broadcast(labelled_keys(able, "doc_id", "toxic", per_class))
    sample = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id"), "toxic", 2 * per_class).select("toxic", "text")

    def counted(keys_of):
        """Sums of (term, toxic texts, clean texts) over the sample."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = {0: Counter(), 1: Counter()}
            for b in small(batches):
                for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n[int(toxic == 1)].update({*keys_of(fold(t or "")), "#"})
            keys = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([n[k][x] for x in keys], pa.int64()) for k in (1, 0))], ["term", "toxic", "clean"])

        return sample.mapInArrow(tidy(count), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def terms(text: str) -> set[str]:
        words = set(_WORD.findall(text))
        return {"w" + w for w in words} | {"b" + w[:k] for w in words for k in PREFIXES if len(w) > k}

    sums = counted(terms)
    total = sums.where("term = '#'").first()
    if total is None or not total.toxic:
        return Lexicon({}, {})
    weight = F.log((F.col("toxic") + 0.5) / F.lit(total.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(total.clean + 1.0))
    enough = float(np.log(max(sums.count(), 1) / chance_terms))
    share = min(max(total.toxic / (total.toxic + total.clean), 1e-9), 1 - 1e-9)
    top = sums.where(F.col("term") != "#").withColumn("weight", weight).where((F.col("weight") >= odds) & (_surprise(F.col("toxic"), F.col("clean"), share) >= enough)).orderBy("term").collect()  # of the bounded sample
    words, beginnings = ({r.term[1:]: r.weight for r in top if r.term[0] == k} for k in "wb")

    def phrases(text: str) -> set[str]:
        own = text.split()
        hit = [any(x in words or x[:k] in beginnings for k in PREFIXES) for x in own]
        return {f"{a} {b}" for a, b, x, y in zip(own, own[1:], hit, hit[1:], strict=False) if x or y}

    spared = counted(phrases).where((F.col("term") != "#") & (F.col("toxic") == 0) & (F.col("clean") >= 2)).orderBy("term").collect() if top else []
    lexicon = Lexicon(words, beginnings, tuple(r.term for r in spared))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in small(batches):
            h = [lex.hits(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in h], pa.float64()), pa.array([x[1] for x in h], pa.int64())], ["toxic", "weight", "n"])

    rows = sample.mapInArrow(measure, "toxic int, weight double, n long").collect()  # numbers of the bounded sample
    rows = sorted((r.toxic, r.weight, r.n) for r in rows)
    y = np.asarray([r[0] == 1 for r in rows], dtype=np.float64)
    w, n = np.asarray([r[1] for r in rows]), np.asarray([max(r[2], 1) for r in rows])
    x = np.stack([np.ones(len(w)), np.log1p(w), np.log1p(100 * w / n)], axis=1)
    c = np.zeros(3)
    ridge = np.asarray([1e-5, 1e-4, 1e-4]) * len(y)  # small: rows that the lexicon parts well get scores near 0 and 1
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        c = c + np.linalg.solve(h, x.T @ (y - p) - ridge * c)
    lexicon.curve = tuple(float(v) for v in c)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    An empty or null text has no hits. Repeated rows and rows without a doc_id (not held out) come out as
    they came in; texts of any length are read whole, other columns are not read, an empty table gives no rows. Of
    terms that begin at one place the heaviest counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([lex.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 3_000, threshold: float = 0.7) -> DataFrame:
    """Learn from ``labels`` and score all of ``docs``; see ``train`` and ``score``."""
    return score(docs, train(docs, labels, per_class=per_class), threshold=threshold)
