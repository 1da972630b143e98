"""Packing of documents into fixed-length sequences by minimum bin slack.

A document's ids with the end id form one piece, or, where there are more than the sequence length,
pieces of exactly that length after a first, shorter one. Which lengths share a sequence is decided on
the histogram of piece lengths alone (at most `capacity` numbers, however many documents): the
longest length left is fixed, a bitset subset-sum over the lengths left finds the fullest sequence
that holds it, and that combination is taken as often as the counts allow. Each piece then finds its
place from its rank among the pieces of its length, which is counted in each task and summed over
the tasks, so that no task has to see a whole length class.

Cases: a null or empty text is the end id alone. Repeated rows are packed once for each row. A null
doc_id is packed as any other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm import common, tokens

CAPACITY, END_ID = 1024, 2
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fullest(available: list[tuple[int, int]], room: int) -> list[int]:
    """Lengths, from (length, count) pairs in descending order of length, with the greatest sum of at
    most `room`. Bit s of the set is on when the sum s can be reached."""
    reached, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length, count in available:
        if length > room:
            continue
        for _ in range(min(count, room // length)):
            wider = (reached | reached << length) & mask
            if wider == reached:
                break
            steps.append((length, reached))
            reached = wider
            if reached >> room:
                break
        if reached >> room:
            break
    total, chosen = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        if not (before >> total) & 1:
            chosen.append(length)
            total -= length
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many sequences, their lengths in descending order) until no piece is left."""
    left = {n: c for n, c in counts.items() if c}
    plans: list[tuple[int, list[int]]] = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest(sorted(((n, c) for n, c in left.items() if c), reverse=True), capacity - longest)
        left[longest] += 1
        used: dict[int, int] = {}
        for n in (chosen := sorted([longest, *rest], reverse=True)):
            used[n] = used.get(n, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        plans.append((times, chosen))
    return plans


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, plans: list[tuple[int, list[int]]]):
        rows: list[tuple[int, int, int, int, list[int]]] = []  # length, first rank, first sequence, pieces a sequence, their offsets
        taken: dict[int, int] = {}
        sequence = 0
        for times, lengths in plans:
            offsets: dict[int, list[int]] = {}
            at = 0
            for n in lengths:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, at_ in offsets.items():
                rows.append((n, taken.get(n, 0), sequence, len(at_), at_))
                taken[n] = taken.get(n, 0) + times * len(at_)
            sequence += times
        rows.sort(key=lambda r: r[:2])
        self.length, self.rank, self.sequence, self.each = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.first = np.concatenate(([0], np.cumsum(self.each)))[:-1].astype(np.int64) if rows else np.zeros(0, np.int64)
        self.offsets = np.array([o for r in rows for o in r[4]], np.int64)
        self.order = (self.length << 44) + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.order, (length << 44) + rank, "right") - 1
        nth = rank - self.rank[row]
        return self.sequence[row] + nth // self.each[row], self.offsets[self.first[row] + nth % self.each[row]]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(documents: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row for each piece: its ids' checksum, the task that made it and its place among the
    pieces of its length in that task."""
    path = path or vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.encoder(path, tokens.LEADING).encode_all
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for i, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, nth))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_SCHEMA)


def pack(documents: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = common.materialize(pieces(documents, capacity=capacity, end_id=end_id, path=path), "pieces")
    by_task = common.materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = places.find(length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    ranked = cut.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
