"""Ordinal regression on graded ratings: one weight vector over hashed text, ordered thresholds between the grades."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .text import per_text, text_of

BUCKETS, TRAINING_DOCS = 1 << 18, 8_000
_MARKS = ".,;:!?\"'()[]{}%$#&*|<>-_/\\"
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs of one kind as one; other characters as they are."""
    out = ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(kind):
            out += kind
        if len(out) >= 8:
            break
    return out


class Buckets(dict):
    """Feature buckets of a word: the word without marks in lower case, its first letters, and its shape.

    Forgets all words at a limit.
    """

    def __init__(self, n: int, limit: int = 300_000):
        super().__init__()
        self.n, self.limit = n, limit

    def bucket(self, feature: str) -> int:
        return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) % self.n

    def __missing__(self, word: str) -> tuple[int, int, str]:
        if len(self) >= self.limit:
            self.clear()
        plain = word.strip(_MARKS).lower()
        self[word] = found = self.bucket("w " + plain), self.bucket("p " + plain[:4]), shape(word)
        return found

    def of(self, text: str) -> np.ndarray:
        """Distinct buckets of a text: words, beginnings, the shares of each shape, of distinct words, of words with symbols
        and of lines without a closing mark, and the words a line.
        """
        words = text.split()
        if not words:
            return np.array([self.bucket("empty")], dtype=np.int64)
        out, shapes = set(), {}
        counts = Counter(words)
        for word, n in counts.items():
            whole, start, form = self[word]
            out.add(whole)
            out.add(start)
            shapes[form] = shapes.get(form, 0) + n
        for form, n in shapes.items():
            out.add(self.bucket(f"s {form} {round(4 * (n / len(words)) ** 0.5)}"))
        out.add(self.bucket(f"share {10 * len(counts) // len(words)}"))
        symbols = sum(n for word, n in counts.items() if _SYMBOLS.search(word))
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        out.add(self.bucket(f"symbols {int(20 * (symbols / len(words)) ** 0.5)}"))
        out.add(self.bucket(f"open {10 * sum(x[-1] not in '.!?' for x in lines) // len(lines)}"))
        out.add(self.bucket(f"line {int(4 * np.log2(1 + len(words) / len(lines)))}"))
        return np.array(sorted(out), dtype=np.int64)


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(score - threshold k), thresholds ascending. ``cut``: the tail from which a text is selected."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def tails(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(float(self.weights[features].sum()) - self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, buckets: int = BUCKETS, rounds: int = 8,
        rate: float = 0.1, ridge: float = 3e-3, min_rows: int = 20, seed: int = 1) -> Ordinal:
    """Cumulative-link regression by stochastic steps scaled per weight; the mean of the later rounds' weights is kept.

    Buckets that fewer than ``min_rows`` rows have, or a tenth of all where that is less, keep weight 0. The thresholds are their first value plus squared
    steps, so they stay in order. A rarer grade counts more, at most threefold.
    """
    weights, seen, power = np.zeros(buckets), np.zeros(buckets, dtype=np.int64), np.full(buckets, 1e-6)
    for r in rows:
        seen[r] += 1
    rows = [r[seen[r] >= min(min_rows, -(-len(rows) // 10))] for r in rows]
    cuts_power = np.full(levels - 1, 1e-6)
    first, steps = 0.0, np.ones(levels - 2)
    counts = np.maximum(np.bincount(grades, minlength=levels), 1)
    weight_of = np.minimum(counts.max() / counts, 3.0)
    above = grades[:, None] > np.arange(levels - 1)
    rng = np.random.default_rng(seed)
    kept, kept_cuts, n_kept = np.zeros(buckets), np.zeros(levels - 1), 0
    for turn in range(rounds):
        for i in rng.permutation(len(rows)):
            cuts = first + np.concatenate(([0.0], np.cumsum(steps ** 2)))
            r = rows[i]
            wrong = (sigmoid(weights[r].sum() - cuts) - above[i]) * weight_of[grades[i]]
            g = wrong.sum() + ridge * weights[r]
            power[r] += g * g
            weights[r] -= rate * g / np.sqrt(power[r])
            cuts_power += wrong ** 2
            move = rate * wrong / np.sqrt(cuts_power)
            first += move.sum() / (levels - 1)
            for k in range(levels - 2):
                steps[k] = max(steps[k] + move[k + 1:].sum() * 2 * steps[k] / (levels - 1), 0.05)
        if turn >= rounds // 2:
            kept += weights
            kept_cuts += first + np.concatenate(([0.0], np.cumsum(steps ** 2)))
            n_kept += 1
    return Ordinal((kept / n_kept).astype(np.float32), kept_cuts / n_kept)


def best_cut(tails: np.ndarray, wanted: np.ndarray) -> float:
    """The cut that selects the most of the wanted rows and the fewest others, as shares; 0.5 without both kinds.

    Halfway between the tails on its two sides; of equally good cuts the one nearest to 0.5.
    """
    if not wanted.any() or wanted.all():
        return 0.5
    order = np.argsort(-tails, kind="stable")
    gain = np.cumsum(np.where(wanted[order], 1 / wanted.sum(), -1 / (~wanted).sum()))
    sorted_tails = tails[order]
    ends = np.flatnonzero(np.diff(sorted_tails, append=-1.0))
    cuts = (sorted_tails[ends] + np.append(sorted_tails[ends[:-1] + 1], 0.0)) / 2
    best = np.flatnonzero(gain[ends] >= gain[ends].max() - 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])


def fit_and_cut(rows: list[np.ndarray], grades: np.ndarray, levels: int, buckets: int, select_grade: int) -> Ordinal:
    """Fit on four of five rows; the cut is picked on the fifth. With fewer than 50 rows all are fitted and the cut is 0.5."""
    if len(rows) < 50:
        return fit(rows, grades, levels, buckets)
    held = np.arange(len(rows)) % 5 == 4
    model = fit([r for r, h in zip(rows, held) if not h], grades[~held], levels, buckets)
    tails = np.array([model.tails(r)[select_grade - 1] for r, h in zip(rows, held) if h])
    model.cut = best_cut(tails, grades[held] >= select_grade)
    return model


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): 0 toxic, 1 of low quality, 2 good. Rows with a null are not rated; of several ratings the lowest counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    whole = labels.where(F.col("toxic").isNotNull() & F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    return whole.groupBy(id_col).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 3,
          max_docs: int = TRAINING_DOCS, buckets: int = BUCKETS, select_grade: int = 2) -> Ordinal:
    """Fit on at most ``max_docs`` rated documents, those with the smallest hash of the id; only their buckets are collected.
    Every fifth of them, in order of the ids, serves to pick the cut.

    Of the rows of one id, the text with the smallest digest counts.
    """
    sample = ratings.orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    rated = docs.select(F.col(id_col), text_of(text_col).alias("__text")).join(F.broadcast(sample), id_col)
    rated = rated.groupBy(id_col).agg(F.first("grade").alias("grade"), F.min_by("__text", F.sha2("__text", 256)).alias("__text"))

    def make():
        table = Buckets(buckets)
        return lambda texts: {"features": [table.of(t) for t in texts]}

    column = per_text(F.col("__text"), make, "struct<features:array<bigint>>", docs.sparkSession)
    rows = rated.select(id_col, "grade", column.alias("f")).select(id_col, "grade", "f.features").toLocalIterator()
    rows = sorted(((r[id_col], r.grade, np.array(r.features)) for r in rows), key=lambda r: (r[0], len(r[2]), r[2].tolist()))
    if not rows:
        return Ordinal(np.zeros(buckets, dtype=np.float32), np.arange(levels - 1.0))
    return fit_and_cut([r[2] for r in rows], np.array([r[1] for r in rows]), levels, buckets, select_grade)


def grade_documents(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 3,
    select_grade: int = 2, select_at: float | None = None, max_docs: int = TRAINING_DOCS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, expected_grade (0 to levels - 1), tail (probability of ``select_grade`` or better), selected, ``carry``.

    ``ratings``: id, grade from 0. Selected are tails of ``select_at`` or more; by default the cut that parts held-out rated
    documents best (``best_cut``). The model is fitted on a bounded sample (``max_docs``) and applied to every row by its
    whole text. Without ratings all weights are 0. A null or empty text is scored by one feature of its own. Repeated
    rows get the same scores; null ids are scored, and never rated. The weights sent along are 4 bytes a bucket.
    """
    spark = docs.sparkSession
    trained = train(docs, ratings, id_col, text_col, levels, max_docs, select_grade=select_grade)
    model, cut = spark.sparkContext.broadcast(trained), trained.cut if select_at is None else select_at

    def make():
        fitted, table = model.value, Buckets(len(model.value.weights))

        def body(texts):
            tails = [fitted.tails(table.of(t)) for t in texts]
            return {"expected_grade": [float(t.sum()) for t in tails], "tail": [float(t[select_grade - 1]) for t in tails]}
        return body

    column = per_text(text_of(text_col), make, "struct<expected_grade:double,tail:double>", spark)
    out = docs.select(F.col(id_col).alias("__id"), column.alias("__made"), *[F.col(c).alias(f"__rest_{c}") for c in carry])
    return out.select(
        F.col("__id").alias(id_col), "__made.expected_grade", "__made.tail", (F.col("__made.tail") >= cut).alias("selected"),
        *[F.col(f"__rest_{c}").alias(c) for c in carry])
