"""Linear models over hashed n-gram indicators, fitted on a bounded sample of labelled rows.

The sample (`bound` documents, those whose hashed key is smallest, one row each, and of these as many as
MOST_BUCKETS allows) comes to the driver as lists of buckets; everything else runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common
from veilspan.llm.features import hashed_buckets

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 6000
#: Buckets of all rows of the sample together, at most (4 bytes each).
MOST_BUCKETS = 1 << 26


@dataclass(frozen=True)
class Hashing:
    """Which n-grams are hashed into 2 ** bits buckets."""

    bits: int = 18
    char_sizes: tuple[int, ...] = (2, 3)
    word_sizes: tuple[int, ...] = (1, 2)

    def buckets(self, text: str | None) -> np.ndarray:
        return hashed_buckets((text or "").encode("utf-8", "surrogatepass"), self.bits, self.char_sizes, self.word_sizes)


@dataclass
class Rows:
    """Sparse indicator rows: the buckets of row i are at[i] .. at[i + 1] of `buckets`."""

    buckets: np.ndarray
    at: np.ndarray
    labels: np.ndarray

    def __len__(self) -> int:
        return len(self.labels)

    def row(self, i: int) -> np.ndarray:
        return self.buckets[self.at[i] : self.at[i + 1]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each row's buckets of a value a bucket."""
        total = np.concatenate(([0.0], np.cumsum(values[self.buckets], dtype=np.float64)))
        return total[self.at[1:]] - total[self.at[:-1]]

    def subset(self, which: np.ndarray) -> Rows:
        rows = [self.row(i) for i in which]
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        return Rows(np.concatenate(rows) if rows else np.zeros(0, np.uint32), at, self.labels[which])


def labelled_rows(documents: DataFrame, labels: DataFrame, hashing: Hashing, *, label: str = "quality", bound: int = SAMPLE_ROWS) -> Rows:
    """The sample's buckets and labels (0 or 1). `documents` has doc_id and text; rows whose key or label is null teach
    nothing, a null text is an empty one, and of several rows of one doc_id the smallest text is taken."""
    known = common.one_label(labels.select("doc_id", label), "doc_id", label)
    chosen = common.bounded_sample(known.join(documents.select("doc_id").distinct(), "doc_id"), "doc_id", bound)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first(label).cast("int").alias("label"), F.min("text").alias("text"))
    rows = rows.select("label", "text", F.xxhash64("doc_id").alias("place"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashing.buckets(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32())), batch.column(2)], names=["label", "buckets", "place"])

    found = common.materialize(rows.mapInArrow(hashed, "label int, buckets array<int>, place long"), "labelled-rows")
    sizes = found.select("place", F.size("buckets").alias("n")).orderBy("place").toArrow()  # `bound` rows
    fit = np.cumsum(sizes.column("n").to_numpy()) <= MOST_BUCKETS
    last = int(sizes.column("place").to_numpy()[fit][-1]) if fit.any() else 0
    got = found.where(F.col("place") <= last).select("label", "buckets").toArrow() if fit.any() else found.select("label", "buckets").limit(0).toArrow()
    common.discard(found)
    lists = got.column("buckets").combine_chunks() if got.num_rows else None
    if lists is None:
        return Rows(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy().astype(np.int64)
    order_key = got.column("label").to_numpy().astype(np.int64)
    rows_ = Rows(lists.values.to_numpy().astype(np.uint32), at, order_key)
    # the order in which executors answer must not matter
    return rows_.subset(np.lexsort((rows_.sums(np.arange(1 << hashing.bits, dtype=np.float64)), np.diff(at), order_key)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to probabilities (Platt), by Newton steps."""
    if len(set(labels.tolist())) < 2:
        return 0.0, (5.0 if len(labels) and labels[0] else -5.0 if len(labels) else 0.0)
    positive, negative = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        weight = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((p - target) * margins).sum() + 1e-6 * a, (p - target).sum()])
        hessian = np.array([[(weight * margins**2).sum() + 1e-6, (weight * margins).sum()], [(weight * margins).sum(), weight.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def folds(n: int, k: int) -> list[np.ndarray]:
    return [np.flatnonzero(np.arange(n) % k == f) for f in range(k)]
