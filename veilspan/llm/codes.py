"""Compressed vectors: each of PARTS consecutive parts of a vector becomes the number of a codebook entry.

Components are integers (SCALE times the component, rounded down). The codebooks start as the parts of the
ENTRIES smallest vec_ids and are moved ROUNDS times by Lloyd's method: every part goes to its nearest entry
(squared Euclidean distance, ties to the lower index), every entry to the componentwise mean of its parts,
rounded down; an entry without parts stays. At the end parts are assigned once more.

Assignments follow Elkan. A vector's row keeps, for each part, the entry, an upper bound of the distance to it,
and one lower bound of the distance to every entry (a byte each, rounded down in steps of the part's largest
bound). When entries move, the bounds are shifted by the movement. An entry is left out only if its lower bound, or half
its distance from the part's own entry, is strictly greater than the upper bound, so that ties are never pruned; what is
left is compared by exact integer distances. Bounds are widened by SLACK, more than doubles can err.

The rows with their bounds are written as Parquet in each round. What reaches the driver is sums and counts of the
entries, which tasks and then Spark's partial aggregation add up before: PARTS times ENTRIES rows at most.

Cases: vectors that are null, or hold null or non-finite components, take no part. Neither do vectors of another
length than the most frequent one (of equally frequent lengths the greatest), nor vectors with a component of
2 ** 21 or more in size, whose integers 32 bits do not hold; an error or a sum of errors that no long holds is
null. If the length is no multiple of PARTS, the first parts are one longer. Rows without vec_id are coded and
count in the means but start an entry only where no row has a vec_id. Repeated rows are coded, and count, once for
each row; of the rows of one vec_id the smallest vector starts an entry. With fewer vec_ids than ENTRIES the
codebooks are as many entries long. Equal vectors give equal entries, of which the first one is used. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = float(1 << 21)
SLACK = 1e-9
#: Integers up to this size are exact as doubles.
EXACT = float(1 << 53)
#: Components compared at once.
AT_ONCE = 1 << 21


def edges(size: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return np.cumsum([0] + [len(p) for p in np.array_split(np.arange(size), PARTS)]).tolist()


def exact_kind(*values: np.ndarray) -> type:
    """The type in which squared distances between integer-valued doubles are exact: doubles where they fit, else Python's integers."""
    most = max(float(np.abs(v).max(initial=0)) for v in values)
    return float if 4 * most * most * max(values[0].shape[-1], 1) < EXACT else object


def squared(x: np.ndarray, y: np.ndarray, kind: type) -> np.ndarray:
    """Exact squared distances, row by row."""
    apart = x - y
    if kind is object:
        apart = apart.astype(np.int64).astype(object)
    return (apart * apart).sum(axis=1)


def half_between(entries: np.ndarray) -> np.ndarray:
    """[entry, entry]: half the distance, not more than it is."""
    return np.array([np.sqrt(((entries - e) ** 2).sum(axis=1)) for e in entries]).reshape(len(entries), len(entries)) / 2 * (1 - SLACK)


class Bounds:
    """What is known of the distances of some rows' parts from the entries of one codebook."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower = entry, upper, lower

    @classmethod
    def none(cls, rows: int, entries: int) -> Bounds:
        return cls(np.zeros(rows, np.int64), np.full(rows, np.inf), np.zeros((rows, entries)))

    def shift(self, moved: np.ndarray) -> None:
        """Every entry has moved by so much."""
        self.upper = (self.upper + moved[self.entry]) * (1 + SLACK)
        self.lower = np.maximum(self.lower - moved * (1 + SLACK), 0) * (1 - SLACK)

    def _unsure(self, apart: np.ndarray) -> np.ndarray:
        """[row, entry]: may the entry be as near as the part's own?"""
        found = (self.lower <= self.upper[:, None]) & (apart[self.entry] <= self.upper[:, None])
        found[np.arange(len(found)), self.entry] = False
        return found

    def _measure(self, x: np.ndarray, entries: np.ndarray, rows: np.ndarray, columns: np.ndarray, found: np.ndarray) -> None:
        step = max(AT_ONCE // max(x.shape[1], 1), 1)
        for at in range(0, len(rows), step):
            r, c = rows[at : at + step], columns[at : at + step]
            found[r, c] = squared(x[r], entries[c], object if found.dtype == object else float)
            self.lower[r, c] = np.sqrt(found[r, c].astype(float)) * (1 - SLACK)

    def assign(self, x: np.ndarray, entries: np.ndarray, apart: np.ndarray, exact: bool) -> tuple[np.ndarray, int]:
        """Make the nearest entries the rows' own. Returns their squared distances (infinite where bounds alone told
        the entry, unless `exact` asks for all of them) and the number of distances that were computed."""
        found = np.full((len(x), len(entries)), np.inf, exact_kind(x, entries))
        some = np.flatnonzero(self._unsure(apart).any(axis=1) | ~np.isfinite(self.upper) | exact)
        self._measure(x, entries, some, self.entry[some], found)  # the own entry first: its bound becomes tight
        self.upper[some] = np.sqrt(found[some, self.entry[some]].astype(float)) * (1 + SLACK)
        near, columns = np.nonzero(self._unsure(apart)[some])
        self._measure(x, entries, some[near], columns, found)
        if len(some):
            self.entry[some] = found[some].argmin(axis=1)  # the first of equal ones
            self.upper[some] = np.sqrt(found[some, self.entry[some]].astype(float)) * (1 + SLACK)
        return found[np.arange(len(x)), self.entry], len(some) + len(near)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """entry, upper, lower in steps of a byte, and the step."""
        step = self.lower.max(axis=1, initial=0) / 255
        lower = np.floor(self.lower / np.where(step > 0, step, 1)[:, None])
        return self.entry.astype(np.uint8), self.upper, np.minimum(lower, 255).astype(np.uint8), step

    @classmethod
    def unpacked(cls, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: np.ndarray) -> Bounds:
        return cls(entry.astype(np.int64), upper.copy(), lower * (step * (1 - SLACK))[:, None])


class Books:
    """The codebooks of all parts, and how far entries moved since those before."""

    def __init__(self, entries: list[np.ndarray], before: Books | None = None):
        self.entries = entries
        self.moved = [np.sqrt(((a - b) ** 2).sum(axis=1)) * (1 + SLACK) for a, b in zip(entries, before.entries, strict=True)] if before else None
        self.apart = [half_between(e) for e in entries]

    def assign(self, vectors: np.ndarray, state: list[Bounds], exact: bool) -> tuple[list[int | None], int]:
        """Each vector's error (null if no long holds it; no errors unless `exact`) and the number of distances computed;
        `state` is brought up to date."""
        errors, computed, cut = np.zeros(len(vectors), object), 0, edges(vectors.shape[1])
        for p, bounds in enumerate(state):
            if self.moved is not None:
                bounds.shift(self.moved[p])
            best, some = bounds.assign(vectors[:, cut[p] : cut[p + 1]], self.entries[p], self.apart[p], exact)
            errors, computed = errors + (best if best.dtype == object else best.astype(np.int64)).astype(object) if exact else errors, computed + some
        return [e if e < 1 << 63 else None for e in errors], computed

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _binary(values: np.ndarray) -> pa.Array:
    """One value of bytes for each row of an array of at least one column."""
    values = np.ascontiguousarray(values)
    size = values.strides[0] if values.ndim > 1 else values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * size), pa.py_buffer(values.tobytes())])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The rows of a column of equally long byte strings."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1) if len(column) and data else np.zeros((len(column), 0), kind)


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (integers) of the rows that take part."""
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    whole = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(fits)
    lengths = whole.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return whole.where(F.size("embedding") == length).select("vec_id", "label", vector.alias("vector"))


def first_books(vectors: DataFrame) -> Books | None:
    """The parts of the ENTRIES smallest vec_ids (of one vec_id's rows the smallest vector)."""
    ids = [r["vec_id"] for r in vectors.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    if ids:
        found = vectors.where(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("vector").alias("vector")).collect()
    else:  # rows without vec_id alone
        found = vectors.orderBy("vector").limit(1).collect()
    if not found:
        return None
    rows = np.array([r["vector"] for r in sorted(found, key=lambda r: r["vec_id"] or 0)], float).reshape(len(found), -1)
    cut = edges(rows.shape[1])
    return Books([rows[:, a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])


_COLUMNS = ("vector", "entry", "upper", "lower", "step")


def _assigned(table: DataFrame, books: Books, last: bool) -> DataFrame:
    """The rows with their entries and bounds under new codebooks; at last vec_id, label, code, error."""
    label = table.schema["label"].dataType.simpleString()
    entries = [len(e) for e in books.entries]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            if books.moved is None:
                lists = batch.column(2)
                vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if len(lists.flatten()) else np.zeros((rows, 0), np.int32)
                state = [Bounds.none(rows, n) for n in entries]
            else:
                vectors = _matrix(batch.column(2), "<i4")
                entry, upper, lower, step = (_matrix(batch.column(i), kind) for i, kind in ((3, "u1"), (4, "<f8"), (5, "u1"), (6, "<f8")))
                lower = lower.reshape(rows, PARTS, -1)
                state = [Bounds.unpacked(entry[:, p], upper[:, p], lower[:, p], step[:, p]) for p in range(PARTS)]
            errors, _ = books.assign(vectors.astype(float), state, last)
            ids = [batch.column(0), batch.column(1)]
            if last:
                code = np.stack([s.entry.astype(np.uint8) for s in state], axis=1)
                yield pa.RecordBatch.from_arrays([*ids, _binary(code), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                packed = [np.stack(x, axis=1) for x in zip(*(s.packed() for s in state), strict=True)]
                yield pa.RecordBatch.from_arrays([*ids, *map(_binary, [vectors.astype("<i4"), *packed])], names=["vec_id", "label", *_COLUMNS])

    kept = "code binary, error long" if last else ", ".join(f"{c} binary" for c in _COLUMNS)
    return table.mapInArrow(assign, f"vec_id long, label {label}, {kept}")


def _moved(table: DataFrame, books: Books) -> Books:
    """Every entry at the mean of its parts, rounded down."""
    widths = [e.shape[1] for e in books.entries]
    cut, most = edges(sum(widths)), max(widths)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            vectors, entry = _matrix(batch.column(0), "<i4").astype(np.int64), _matrix(batch.column(1), "u1")
            for p in range(PARTS if batch.num_rows else 0):
                np.add.at(sums[p], entry[:, p], vectors[:, cut[p] : cut[p + 1]])
                counts[p] += np.bincount(entry[:, p], minlength=len(counts[p]))
        places = [(p, e) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        columns = [pa.array([x[i] for x in places], pa.int32()) for i in (0, 1)]
        columns += [pa.array([counts[p][e] for p, e in places], pa.int64())]
        columns += [pa.array([sums[p][e, i] if i < widths[p] else 0 for p, e in places], pa.int64()) for i in range(most)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(most))])

    summed = [f"s{i}" for i in range(most)]
    parts = table.select("vector", "entry").mapInArrow(add, ", ".join(["part int, entry int, n long", *(f"{s} long" for s in summed)]))
    entries = [e.copy() for e in books.entries]
    for r in parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in summed)).collect():
        entries[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(widths[r["part"]])]
    return Books(entries, books)


def compress(embeddings: DataFrame) -> tuple[DataFrame, Books | None]:
    """vec_id, label, code (a byte for each part), error of the rows that take part, and the codebooks (None without rows)."""
    vectors = vectors_of(embeddings)
    label = vectors.schema["label"].dataType.simpleString()
    books = first_books(vectors)
    if books is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id long, label {label}, code binary, error long"), None
    table = vectors
    for _ in range(ROUNDS):
        before, table = table, common.materialize(_assigned(table, books, last=False), "vector-bounds")
        if hasattr(before, "scratch_path"):
            common.discard(before)
        books = _moved(table, books)
    return _assigned(table, books, last=True), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(common.table(spark, sf_dir, "embeddings"))
    coded = common.materialize(coded, "vector-codes") if books else coded
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def _sql() -> str:
    """The contract on small tables, every distance computed; one pair of relations for each round."""
    parts = [
        """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS (
  SELECT p, e, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut) WHERE e < 256
)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""near{r} AS (
  SELECT vec_id, p, any_value(x) AS x, min((d, e)) AS best FROM (
    SELECT vec_id, cut.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN book{r} b ON b.p = cut.p
  ) GROUP BY vec_id, p
)""")
        if r < ROUNDS:
            parts.append(f"""book{r + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS c FROM (
      SELECT p, best[2] AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s FROM near{r}, (SELECT unnest(range(1, 4097)) AS i) WHERE i <= len(x) GROUP BY ALL
    ) GROUP BY p, e
  ) m ON m.p = b.p AND m.e = b.e
)""")
    return f"""
WITH {", ".join(parts)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id
), hashed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), hashed
"""


SQL = _sql()
