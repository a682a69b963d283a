"""Quality by co-training: a text view and a metadata view teach each other, then vote."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import (
    SAMPLE_ROWS,
    Logistic,
    fit_logistic,
    held_out,
    labelled_ids,
    sample_rows,
)
from .texts import annotate, staged

#: Rounds in which the views label documents for each other, and what such a label counts.
ROUNDS = 5
GIVEN_WEIGHT = 0.5
#: A view must be this sure of a label that it passes on.
SURE = 0.9
_BUCKETS = 32
_CAPITALS = re.compile("[A-ZÀ-Þ]")
_ODD_CHARACTERS = re.compile(r"[^\w\s.,;:!?'\"()\[\]-]")


def text_view(text: str | None) -> list[float]:
    """What the text alone shows: its make-up, variety and repetition. No words: zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * 10
    lines = [line for line in text.split("\n") if line.strip()]
    size, unique = len(text), len(set(words))
    letters = sum(map(len, words))
    odd = len(_ODD_CHARACTERS.findall(text))
    digits = sum(map(text.count, "0123456789"))
    return [
        odd / size,
        digits / size,
        unique / len(words),
        unique / len(words) ** 0.75,
        len(set(lines)) / max(1, len(lines)),
        letters / len(words),
        np.log1p(len(words)),
        len(lines) / len(words),
        sum(map(text.count, ".!?")) / len(words),
        len(_CAPITALS.findall(text)) / size,
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What the row says about the text: language, source and stated length. Nulls are a value."""
    size = np.log1p(max(0, n_chars or 0))
    out = [size, size * size, float(n_chars is None)] + [0.0] * (2 * _BUCKETS)
    for at, value in ((3, lang), (3 + _BUCKETS, source)):
        out[at + zlib.crc32((value or "").encode()) % _BUCKETS] = 1.0
    return out


@dataclass
class CoTrained:
    """The view models, each view's calibration, and the weights of the vote."""

    text: Logistic
    metadata: Logistic
    vote: Logistic

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return self.vote.scores(np.stack([self.text.logits(text), self.metadata.logits(metadata)], 1))


def _added(unlabelled: DataFrame, sums, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Arrays of the given sizes that `sums` makes of each batch's views, added over all rows by Spark."""
    starts = np.cumsum([0, *sizes])

    def run(batches):
        total = np.zeros(starts[-1])
        for batch in batches:
            if batch.num_rows:
                flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("text", "metadata")]
                views = [x.reshape(batch.num_rows, -1) for x in flat]
                total += np.concatenate([part.ravel() for part in sums(views)])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "s"])

    out = np.zeros(starts[-1])
    for row in unlabelled.mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[row["k"]] = row["s"]
    return np.split(out, starts[1:-1])


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _start(views: tuple[np.ndarray, np.ndarray], unlabelled: DataFrame) -> list[Logistic]:
    """No weights yet, but mean and scale of each view over the labelled and all unlabelled rows."""
    widths = [x.shape[1] for x in views]

    def sums(found):
        return [part for x in found for part in (np.array([len(x)]), x.sum(0), (x * x).sum(0))]

    rest = _added(unlabelled, sums, tuple(n for width in widths for n in (1, width, width)))
    models = []
    for k, x in enumerate(views):
        count, first, second = (a + b for a, b in zip(sums([x]), rest[3 * k : 3 * k + 3], strict=True))
        mean = first / count
        scale = np.sqrt(np.maximum(second / count - mean**2, 0))
        models.append(Logistic(mean, np.where(scale < 1e-6, 1.0, scale), np.zeros(len(mean) + 1)))
    return models


def _taught(
    students: list[Logistic], teachers: list[Logistic], views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, unlabelled: DataFrame, ridge: float = 1.0
) -> list[Logistic]:
    """Both views, fitted on the labelled rows and on every row that the other view's teacher is sure of.

    Newton steps as in fit_logistic; each reads all unlabelled rows once, for both views.
    """

    def sums(models, found, given, weights):
        """Gradient and Hessian of each view by its columns and a constant."""
        parts = []
        for model, x, y, weight in zip(models, found, given, weights, strict=True):
            p, x = model.scores(x), _ones(x)
            parts += [x.T @ (weight * (p - y)), (x * (weight * p * (1 - p) + 1e-9 * (weight > 0))[:, None]).T @ x]
        return parts

    def taught(models):
        def run(found):
            towards = [teachers[1 - k].scores(found[1 - k]) for k in (0, 1)]
            weights = [GIVEN_WEIGHT * (np.maximum(t, 1 - t) >= SURE) for t in towards]
            return sums(models, found, [(t >= 0.5).astype(float) for t in towards], weights)

        return run

    sizes = tuple(n for x in views for n in (x.shape[1] + 1, (x.shape[1] + 1) ** 2))
    models = list(students)
    for _ in range(30):
        rest = _added(unlabelled, taught(tuple(models)), sizes)
        own = sums(models, views, (labels, labels), [np.ones(len(labels))] * 2)
        largest = 0.0
        for k, model in enumerate(models):
            width = len(model.weights)
            # from columns to standardised columns
            to = np.diag(np.append(1 / model.scale, 1.0))
            to[:-1, -1] = -model.mean / model.scale
            penalty = np.full(width, ridge)
            penalty[-1] = 1e-6
            gradient = to @ (own[2 * k] + rest[2 * k]) + penalty * model.weights
            hessian = to @ (own[2 * k + 1] + rest[2 * k + 1].reshape(width, width)) @ to.T + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            models[k] = Logistic(model.mean, model.scale, model.weights - step)
            largest = max(largest, np.abs(step).max())
        if largest < 1e-6:
            break
    return models


def co_train(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, unlabelled: DataFrame) -> CoTrained:
    """Rounds in which each view labels all unlabelled rows that it is sure of for the other.

    Both start from the labelled rows. Every round scores every unlabelled row anew with
    both views; a row counts for a view if the other one is sure of its label. The vote is
    a logistic model of both views' logits on the labelled rows, which calibrates them.
    """
    models = [fit_logistic(x, labels) for x in views]
    if len(set(labels.tolist())) == 2:
        students = _start(views, unlabelled)
        for _ in range(ROUNDS):
            models = students = _taught(students, models, views, labels, unlabelled)
    logits = np.stack([models[k].logits(views[k]) for k in (0, 1)], 1) if len(labels) else np.zeros((0, 2))
    return CoTrained(models[0], models[1], fit_logistic(logits, labels))


def _views(rows, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(row[text_col]) for row in rows]).reshape(len(rows), 10)
    metadata = np.array([metadata_view(row["lang"], row["source"], row["n_chars"]) for row in rows])
    return text, metadata.reshape(len(rows), 3 + 2 * _BUCKETS)


def _unlabelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Both views of every row that has no row in labels: (text, metadata), written once."""

    def run(batch):
        return [pa.array(view.tolist(), pa.list_(pa.float64())) for view in _views(_rows(batch, text_col), text_col)]

    viewed = annotate(_typed(docs, id_col, text_col), {"text": "array<double>", "metadata": "array<double>"}, run, [id_col])
    rest = viewed.join(labels.select(id_col), id_col, "left_anti")
    return staged(rest.select("text", "metadata"), "unlabelled")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS
) -> CoTrained:
    """Fits on at most `rows` labelled rows of each label that are not held out, and on all rows without labels.

    Labelled texts over SAMPLE_TEXT_BYTES are not learnt from; of unlabelled rows, all
    are, and copies each count. The driver gets sums over them only. With no label or
    only one, the score is a constant.
    """
    columns = [text_col, "lang", "source", "n_chars"]
    found = sample_rows(docs, labelled_ids(labels, "quality", id_col, rows), columns, id_col, text_col)
    given = np.array([row["label"] for row in found], float)
    return co_train(_views(found, text_col), given, _unlabelled(docs, labels, id_col, text_col))


def _typed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        id_col, F.col(text_col).cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")
    )


def _rows(batch: pa.RecordBatch, text_col: str) -> list[dict]:
    names = (text_col, "lang", "source", "n_chars")
    return [dict(zip(names, values, strict=True)) for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, text_score, metadata_score, predicted) of every row; 1 is good.

    Whole texts are read, each row by itself. Null and empty texts and null metadata
    have defined views.
    """

    def run(batch):
        text, metadata = _views(_rows(batch, text_col), text_col)
        scores = model.scores(text, metadata)
        made = (scores, model.text.scores(text), model.metadata.scores(metadata))
        return [*(pa.array(x, pa.float64()) for x in made), pa.array((scores >= 0.5).astype(np.int32))]

    results = {"score": "double", "text_score": "double", "metadata_score": "double", "predicted": "int"}
    scored = annotate(_typed(docs, id_col, text_col), results, run, [id_col])
    return scored.withColumn("held_out", held_out(id_col)).select(id_col, "held_out", *results)
