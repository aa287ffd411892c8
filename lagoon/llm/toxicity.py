"""Toxicity grades by a cumulative-link model on sparse text features.

Features are words, and the beginnings of words. A feature's value grows with the
share of a row's distinct words that have it, by the square root, so that the few
telling words of a long text weigh less than those of a short one. A row's score is
the sum of its features' values by their weights. Grades are ordered; the chance of a grade above k is
logistic(score - threshold k), with one set of weights for all thresholds, and
the expected severity is the sum of these chances.

Fitted on the driver, on at most `sample` labelled rows; applied to all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, keep_rows, slices

#: Labelled rows used for fitting, features kept, buckets features are hashed to.
SAMPLE = 8_000
FEATURES = 2_048
BUCKETS = 1 << 20
PREFIXES = (4, 5)
#: A feature is kept if its chi-squared with the label passes this (one in a thousand by chance), in this many rows.
CHI2 = 10.83
ROWS = 4
#: A feature's value is the root of SCALE times its words over all distinct words and a few, MOST at most.
SCALE, FEW, MOST = 40, 10, 3.0
WORDS_CACHED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    out = [zlib.crc32(word.encode()) % BUCKETS]
    return out + [zlib.crc32(b"\0" + word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n]


def value(count: int, words: int) -> float:
    """Of a feature that `count` of a row's distinct words have."""
    return min(MOST, math.sqrt(SCALE * count / (words + FEW)))


@dataclass(frozen=True)
class Model:
    """weights by feature; thresholds ascending, one below each grade but the least. Without thresholds all is grade 0."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def scorer(self):
        cache: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            if len(cache) > WORDS_CACHED:
                cache.clear()
            found: dict[int, int] = {}
            words = set(_WORD.findall(text.lower()))
            for w in words:
                f = cache.get(w)
                if f is None:
                    f = cache[w] = tuple({x for x in features(w) if x in self.weights})
                for x in f:
                    found[x] = found.get(x, 0) + 1
            return sum(self.weights[x] * value(found[x], len(words)) for x in sorted(found))

        return score

    def above(self, score: float) -> list[float]:
        """Chance of a grade above 0, above 1, ..."""
        return [float(_logistic(score - t)) for t in self.thresholds]


def _logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of most likely grades less penalty * weights ** 2, by Adam steps.

    Thresholds are the first one plus positive steps, so their order holds throughout.
    """
    n, d = x.shape
    w = np.zeros(d)
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.sort(-np.log(share / (1 - share)))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    params = np.concatenate([w, free])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, free = params[:d], params[d:]
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        score = x @ w.astype(x.dtype)
        # P(grade = k) = F(upper - score) - F(lower - score)
        up, low = bounds[grade + 1] - score, bounds[grade] - score
        f_up, f_low = _logistic(up), _logistic(low)
        p = np.maximum(f_up - f_low, 1e-12)
        d_up, d_low = f_up * (1 - f_up) / p, f_low * (1 - f_low) / p
        g_theta = np.array([(d_low[grade == k + 1].sum() - d_up[grade == k].sum()) / n for k in range(grades - 1)])
        later = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([x.T @ (d_up - d_low).astype(x.dtype) / n + penalty * w, later[:1], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    free = params[d:]
    return params[:d], free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def severities(x: np.ndarray, toxic: np.ndarray, rise: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 where only toxic or not is known: toxic rows with more of the features that speak for toxicity than the median are 2."""
    hits = (x[:, rise] > 0).sum(axis=1)
    middle = np.median(hits[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, 1 + (hits > middle), 0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_column: str = "toxic", graded: bool = False) -> Model:
    """A model from at most `sample` labelled rows, the first by hash of doc_id.

    labels: doc_id and the label: 0 or 1, or grades from 0 where `graded`. Rows with a null
    id or label are left out; labels without a text, too. One label for all rows, or
    no rows: a model that grades everything 0.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label_column).cast("int").alias("y")).dropna().orderBy(F.xxhash64("i"), "i", "y").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).join(F.broadcast(some), "i")

    def work(batch):
        for part in slices(batch, "t"):
            bags, words = [], []
            for t in part.column("t").to_pylist():
                own = set(_WORD.findall((t or "").lower()))
                bags.append(Counter(x for w in own for x in set(features(w))))
                words.append(len(own))
            yield {"y": part.column("y"), "words": words, "f": [sorted(b) for b in bags], "n": [[b[x] for x in sorted(b)] for b in bags]}

    got = arrow_map(rows, work, "y int, words int, f array<int>, n array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return Model({}, ())
    y = got.column("y").to_numpy().astype(np.int64)
    lists = got.column("f").chunk(0) if got.column("f").num_chunks else None
    flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(y)), size)
    words = got.column("words").to_numpy()[row]
    values = np.minimum(MOST, np.sqrt(SCALE * got.column("n").chunk(0).flatten().to_numpy() / (words + FEW)))
    toxic = y > 0
    n, positive = len(y), int(toxic.sum())
    if positive in (0, n):
        return Model({}, ())
    a = np.bincount(flat[toxic[row]], minlength=BUCKETS).astype(float)
    both = np.bincount(flat, minlength=BUCKETS).astype(float)
    b, c = both - a, positive - a
    d = n - positive - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num(n * (a * d - b * c) ** 2 / (both * (n - both) * positive * (n - positive)))
    chosen = np.flatnonzero((chi2 >= CHI2) & (both >= ROWS))
    chosen = np.sort(chosen[np.lexsort((chosen, -chi2[chosen]))][:FEATURES])
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    own = place[flat] >= 0
    x[row[own], place[flat[own]]] = values[own]
    rise = (a * (n - positive) > b * positive)[chosen]
    grade = y if graded else severities(x, y, rise)
    grade = np.searchsorted(np.unique(grade), grade)
    weights, thresholds = fit_cumulative_link(x, grade, int(grade.max()) + 1)
    return Model(dict(zip(chosen.tolist(), weights.tolist(), strict=True)), tuple(thresholds.tolist()))


def grade(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every row; null text counts as empty.

    grade: the most grades that are passed with a chance of a half; toxic: grade over 0.
    """

    def work(batch):
        score = model.scorer()
        for part in slices(batch, "t"):
            above = [model.above(score(t or "")) for t in part.column("t").to_pylist()]
            grades = [sum(p >= 0.5 for p in x) for x in above]
            yield {"doc_id": part.column("i"), "expected_severity": [sum(x) for x in above], "grade": grades, "toxic": [g > 0 for g in grades]}

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))
    return arrow_map(rows, work, "doc_id long, expected_severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of grade 0, with all their columns."""

    def keep():
        score = model.scorer()
        return lambda texts: [not any(p >= 0.5 for p in model.above(score(t))) for t in texts]

    return keep_rows(docs, keep, text_column)
