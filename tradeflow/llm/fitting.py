"""Labelled samples and logistic regression for the classifiers here."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each label, and bytes of a text, that a model may be fitted on.
SAMPLE_ROWS = 2_000
SAMPLE_TEXT_BYTES = 50_000


def held_out(id_col: str) -> Column:
    """Rows that no model here learns from: a fifth, by the CRC-32 of the id as text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def labelled_ids(labels: DataFrame, label: str, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` ids of each label 0 and 1 that are not held out, those of smallest hash."""
    usable = labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    one_each = usable.groupBy(id_col).agg(F.max(label).cast("int").alias("label"))

    def some(value: int) -> DataFrame:
        return one_each.filter(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(rows)

    return some(0).unionByName(some(1))


def sample_rows(docs: DataFrame, ids: DataFrame, columns: list[str], id_col: str, text_col: str) -> list:
    """The rows of a bounded id table, one for each text and label, without very long texts.

    Sorted, so that a model does not depend on the order in which rows arrive.
    """
    short = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) <= SAMPLE_TEXT_BYTES
    wanted = docs.select(id_col, *columns).filter(short).join(F.broadcast(ids), id_col)
    rows = wanted.dropDuplicates([text_col, "label"]).collect()
    return sorted(rows, key=lambda row: (str(row[id_col]), str(row[text_col])))


@dataclass
class Logistic:
    """Weights over standardised features; a constant where one label is missing."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, sure: np.ndarray | None = None) -> Logistic:
    """Newton steps on the penalised likelihood; `sure` weighs the rows."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    weight = np.ones(len(y)) if sure is None else np.asarray(sure, float)
    width = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(width)
    scale = x.std(0) if len(x) else np.ones(width)
    scale = np.where(scale < 1e-9, 1.0, scale)
    weights = np.zeros(width + 1)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights[-1] = np.log(share / (1 - share)) if len(y) else -1.0
        return Logistic(mean, scale, weights)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * weights
        hessian = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, weights)
