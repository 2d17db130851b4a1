"""Quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textmodel import ShapeFeatures, fit_ordinal
from .training import held_out, sample

#: A document is kept when P(grade >= KEEP_GRADE) is at least KEEP_PROBABILITY.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5


class Quality:
    """A fitted model: one weight vector over hashed text features and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, grades: list[int]):
        self.weights, self.cuts, self.grades = weights.astype(np.float32), cuts, grades

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at], self.cuts, self.grades, len(self.weights)

    def __setstate__(self, state):
        at, w, self.cuts, self.grades, n = state
        self.weights = np.zeros(n, np.float32)
        self.weights[at] = w

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= g) for each grade but the lowest; never increasing."""
        if not hasattr(self, "features"):
            self.features = ShapeFeatures()
        s, v = self.features(text)
        return 1 / (1 + np.exp(np.clip(self.cuts - float(self.weights[s] @ v), -30, 30)))


@lru_cache(maxsize=1)
def _shapes() -> ShapeFeatures:
    return ShapeFeatures()


def _features(text: str | None):
    return _shapes()(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text") -> Quality:
    """Fit on a bounded sample of rated rows that are not held out. Grades are the ratings in order; with
    fewer than two grades every text gets the one grade there is (0 without ratings)."""
    y, rows, _ = sample(docs, labels, label, _features, id_col, text)
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Quality(np.zeros(1 << 18), np.zeros(0), grades or [0])
    w, cuts = fit_ordinal(rows, np.searchsorted(grades, y), len(grades))
    return Quality(w, cuts, grades)


def score(docs: DataFrame, model: Quality, text: str = "text", out: str = "quality_score") -> DataFrame:
    """docs plus struct<expected: double, tails: array<double>> of each whole text. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected:double,tails:array<double>>")
    def run(col: pd.Series) -> pd.DataFrame:
        m = shared.value
        steps = np.diff(m.grades)
        tails = [m.tails(t) for t in col]
        return pd.DataFrame({"expected": [float(m.grades[0] + (steps * t).sum()) for t in tails], "tails": [t.tolist() for t in tails]})

    return docs.withColumn(out, run(F.col(text)))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, expected_grade, p_tail = P(grade >= 1) and kept, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rated = score(docs, model)
    above = [i for i, g in enumerate(model.grades[1:], 1) if g >= KEEP_GRADE]
    sure = F.lit(float(model.grades[0] >= KEEP_GRADE))
    tail = sure if model.grades[0] >= KEEP_GRADE or not above else F.element_at("quality_score.tails", above[0])
    return rated.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score.expected").alias("expected_grade"), tail.alias("p_tail"), (tail >= KEEP_PROBABILITY).alias("kept")
    )
