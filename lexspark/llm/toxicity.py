"""Toxicity by a counterfactually regularised classifier."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textmodel import Rows, WordFeatures, fit_logistic, words_of
from .training import held_out, sample

#: Terms of a list name groups of one kind; a counterfactual puts the next term of the list in place of each.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"], ["her", "his"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"], ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab", "african", "european"], ["gay", "lesbian", "straight", "bisexual"], ["transgender", "cisgender"],
    ["old", "young"], ["disabled", "deaf", "blind"], ["immigrants", "natives", "refugees"], ["american", "mexican", "chinese", "french", "german", "spanish", "russian", "indian"],
]
SWAP = {a: g[(i + 1) % len(g)] for g in IDENTITY for i, a in enumerate(g)}
THRESHOLD = 0.3


class Toxicity:
    """A fitted model: weights over hashed words, applied to whole texts."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at], self.bias, len(self.weights)

    def __setstate__(self, state):
        at, w, self.bias, n = state
        self.weights = np.zeros(n, np.float32)
        self.weights[at] = w

    def score(self, text: str | None) -> float:
        if not hasattr(self, "features"):
            self.features = WordFeatures(self.weights != 0)
        s, v = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(float(self.weights[s] @ v) + self.bias, -30, 30))))


def swapped(words: set[str]) -> set[str] | None:
    """The words with the identity terms swapped; null where there are none."""
    return {SWAP.get(w, w) for w in words} if words & SWAP.keys() else None


def counterfactuals(words: list[str | None]) -> tuple[Rows, Rows] | None:
    """Feature rows of the texts that name a group, and of the same texts with the terms swapped."""
    f, a, b = WordFeatures(), [], []
    for x in words:
        ws = set((x or "").split())
        if (other := swapped(ws)) is not None:
            a.append(f.of_words(ws))
            b.append(f.of_words(other))
    return (Rows([s for s, _ in a], [v for _, v in a]), Rows([s for s, _ in b], [v for _, v in b])) if a else None


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", fair: float = 1.0) -> Toxicity:
    """Fit on a bounded sample of labelled rows that are not held out. Without labels the score is constant."""
    y, rows, (named, others) = sample(docs, labels, label, _features, id_col, text, twin=_twin)
    return Toxicity(*fit_logistic(rows, y.astype(float), (rows.pick(named), others) if named else None, fair))


@lru_cache(maxsize=1)
def _words() -> WordFeatures:
    return WordFeatures()


def _features(text: str | None):
    return _words()(text)


def _twin(text: str | None):
    other = swapped(words_of(text))
    return None if other is None else _words().of_words(other)


def score(docs: DataFrame, model: Toxicity, text: str = "text", out: str = "score") -> DataFrame:
    """docs plus a score in [0, 1] of each whole text, null and empty texts too. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in col], dtype="float64")

    return docs.withColumn(out, run(F.col(text)))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


__all__ = ["IDENTITY", "THRESHOLD", "Toxicity", "counterfactuals", "fit", "op7_toxicity", "score", "words_of"]
