"""Quality rules: exact base counts, and a calibrated logistic regression over hashed n-grams.

Words are maximal runs of bytes other than space and 9 to 13. A document fails the base rule with
fewer than 50 words, or when more than half of its words lie in 3-word windows found twice or more.
Of the others those are kept whose calibrated probability of good quality reaches KEEP_AT.

Cases: a null text has no words, fails the base rule and is scored as an empty text. Without labelled
rows of both classes the probability is the same for every text. Repeated rows are judged once for
each row; a null doc_id is judged as any other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import common, learn
from veilspan.llm.features import SPACE, _words

LEAST_WORDS, REPEAT_PERCENT, KEEP_AT = 50, 50, 0.3
HASHING = learn.Hashing(bits=18, char_sizes=(1, 3), word_sizes=(1, 2))
RIDGE, STEPS = 1e-4, 80
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BLANK = " \t\n\v\f\r"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = _words(codes)
    chars = int(((codes & 0xC0 != 0x80) & ~SPACE[codes]).sum())
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    repeated = 0
    if len(words) > 3:
        windows = (words[:-2] * np.uint64(0x9FB21C651E98DF25) + words[1:-1]) * np.uint64(0xD1342543DE82EF95) + words[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        found = np.zeros(len(words) + 3, np.int8)
        twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        for i in range(3):
            found[twice + i] = 1
        repeated = int(found.sum())
    return len(words), chars, int(SYMBOLS[codes].sum()), len(lines) - len(set(lines)), repeated


class Model:
    """Ridge logistic regression on length-normalised indicators, calibrated on rows left out in turn."""

    def __init__(self, rows: learn.Rows, hashing: learn.Hashing = HASHING):
        self.hashing = hashing
        self.weights, self.bias = np.zeros(1 << hashing.bits, np.float32), 0.0
        self.slope, self.offset = learn.calibrate(np.zeros(len(rows)), rows.labels)
        if len(set(rows.labels.tolist())) == 2:
            margins = np.zeros(len(rows))
            for out in learn.folds(len(rows), 3):
                margins[out] = self._fit(rows.subset(np.setdiff1d(np.arange(len(rows)), out)))._margins(rows.subset(out))
            self._fit(rows)
            self.slope, self.offset = learn.calibrate(margins, rows.labels)

    def _fit(self, rows: learn.Rows) -> Model:
        """Accelerated gradient descent; the loss has curvature of at most (1 + 1) / 4 + RIDGE."""
        sizes = np.diff(rows.at)
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        weights = ahead = np.zeros(len(self.weights))
        bias = bias_ahead = 0.0
        rate = 1 / (0.5 + RIDGE)
        for step in range(STEPS):
            error = (learn.sigmoid(rows.sums(ahead) * scale + bias_ahead) - (rows.labels == 1)) / len(rows)
            gradient = np.bincount(rows.buckets, np.repeat(error * scale, sizes), len(weights)) + RIDGE * ahead
            new, new_bias = ahead - rate * 4 * gradient, bias_ahead - rate * 4 * error.sum()
            pull = step / (step + 3)
            ahead, bias_ahead = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
            weights, bias = new, new_bias
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        return self

    def _margins(self, rows: learn.Rows) -> np.ndarray:
        return rows.sums(self.weights) / np.sqrt(np.maximum(np.diff(rows.at), 1)) + self.bias

    def score(self, text: str | None) -> float:
        at = self.hashing.buckets(text)
        margin = self.weights[at].sum(dtype=np.float64) / np.sqrt(max(len(at), 1)) + self.bias
        return float(learn.sigmoid(np.float64(self.slope * margin + self.offset)))


def judge(documents: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and probability of every document."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            scores = np.array([model.score(t) for t in texts])
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(~failed & (scores >= keep_at)), pa.array(scores)], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    kinds = ["long"] * 6 + ["boolean"] * 2 + ["double"]
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judged, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = Model(learn.labelled_rows(documents, common.table(spark, sf_dir, "labels"), HASHING))
    return judge(documents, model)
