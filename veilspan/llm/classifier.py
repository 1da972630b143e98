"""Quality classifier: naive Bayes support vectors.

Each n-gram indicator is scaled by the log ratio of the two classes' smoothed counts of it; on the
scaled, length-normalised rows a linear hinge-loss model is fitted by dual coordinate descent. Margins
become probabilities through a logistic curve fitted on margins of rows left out in turn.

Cases: a null text scores as an empty one. Without labelled rows of both classes the score is the same
for every text (0.5 without any, near the one class otherwise). Repeated labels of a document count
once, with the smallest. A document with a null doc_id is scored; its held_out is null and it teaches
nothing. Repeated documents are scored once for each row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common, learn

SMOOTHING, COST, EPOCHS = 1.0, 4.0, 12
FOLDS, HELD_FOLD, THRESHOLD = 5, 0, 0.3
HASHING = learn.Hashing()


def log_count_ratio(rows: learn.Rows, size: int) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed indicator counts p of label 1 and q of label 0."""
    of_one = np.repeat(rows.labels == 1, np.diff(rows.at))
    p = SMOOTHING + np.bincount(rows.buckets[of_one], minlength=size)
    q = SMOOTHING + np.bincount(rows.buckets[~of_one], minlength=size)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: learn.Rows, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of the scaled buckets and the bias that minimise |w|^2 / 2 + cost * hinge loss."""
    weights, bias = np.zeros(len(ratio)), 0.0
    norms = np.sqrt(np.maximum(rows.sums(ratio**2), 1e-12))
    sign = np.where(rows.labels == 1, 1.0, -1.0)
    dual = np.zeros(len(rows))
    random = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at = rows.row(i)
            x = ratio[at] / norms[i]
            gradient = sign[i] * (weights[at] @ x + bias) - 1
            new = min(max(dual[i] - gradient / 2, 0.0), cost)  # the row and the bias have squared length 2
            if (step := new - dual[i]) != 0:
                weights[at] += step * sign[i] * x
                bias += step * sign[i]
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


class Model:
    """Scores texts: logistic(slope * margin + offset)."""

    def __init__(self, rows: learn.Rows, hashing: learn.Hashing = HASHING):
        self.hashing = hashing
        size = 1 << hashing.bits
        self.weights, self.ratio2, self.bias = np.zeros(size, np.float32), np.ones(size, np.float32), 0.0
        self.slope, self.offset = learn.calibrate(np.zeros(len(rows)), rows.labels)
        if len(set(rows.labels.tolist())) == 2:
            margins = np.zeros(len(rows))
            for out in learn.folds(len(rows), 3):
                rest = rows.subset(np.setdiff1d(np.arange(len(rows)), out))
                if len(set(rest.labels.tolist())) == 2:
                    margins[out] = self._fit(rest)._margins(rows.subset(out))
            self._fit(rows)
            self.slope, self.offset = learn.calibrate(margins, rows.labels)

    def _fit(self, rows: learn.Rows) -> Model:
        ratio = log_count_ratio(rows, len(self.weights))
        weights, self.bias = dual_coordinate_descent(rows, ratio)
        self.weights, self.ratio2 = (weights * ratio).astype(np.float32), (ratio**2).astype(np.float32)
        return self

    def _margins(self, rows: learn.Rows) -> np.ndarray:
        return rows.sums(self.weights) / np.sqrt(np.maximum(rows.sums(self.ratio2), 1e-12)) + self.bias

    def score(self, text: str | None) -> float:
        at = self.hashing.buckets(text)
        margin = self.weights[at].sum(dtype=np.float64) / np.sqrt(max(self.ratio2[at].sum(dtype=np.float64), 1e-12)) + self.bias
        return float(learn.sigmoid(np.float64(self.slope * margin + self.offset)))


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = learn.SAMPLE_ROWS) -> Model:
    """A model of the rows of `documents` that `labels` labels."""
    return Model(learn.labelled_rows(documents, labels, HASHING, label=label, bound=bound))


def with_score(documents: DataFrame, model, *, text: str = "text", score: str = "score") -> DataFrame:
    """`documents` with the model's score of the text appended."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return documents.withColumn(score, scored(F.col(text)))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the rows not held out."""
    fold = common.remainder("doc_id", FOLDS)
    model = fit(documents.where(fold != HELD_FOLD), labels)
    found = with_score(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == HELD_FOLD).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
