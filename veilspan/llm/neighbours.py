"""Approximate nearest neighbours: a forest of random-projection trees whose leaves stay small.

Each node of a tree parts its vectors at the median of their projections on a random direction, one
for each tree and level. The upper levels are fitted on a bounded sample (SAMPLE_ROWS vectors). Then Spark
counts the rows of every leaf, and leaves with more than LEAF_ROWS are parted again by samples of their
own rows, SPLIT_SAMPLE of each leaf, until none is left that its vectors can part. So the number of leaves grows with the
table, up to MOST_LEAVES (what a task holds of the forest is bounded by it; beyond, leaves grow again but
are searched whole). Every vector is filed in its leaf of every
tree. A query walks all trees through one priority queue, ordered by how far the query lies beyond
the splits that part it from a node, until the leaves popped hold `search_rows` vectors; those leaves'
vectors are reranked by their exact distance in double precision.

A query's first leaves (FIRST_ROWS rows) are searched before the others; the k-th distance found there is an upper bound
of the true one, and the other leaves give back only what is not farther.

`search_rows` is measured, not guessed: for CALIBRATION_QUERIES of the queries all rows are
searched exactly, and it is set so that the share RECALL of their true neighbours would be found. Rows
of a leaf are dealt to chunks of CHUNK_ROWS and its queries to parts of ASKED_ROWS, about, so that a crowded leaf is many
groups. Repeats of a
vec_id with the same vector are dropped before they are filed, and with different vectors the distinct
ids are what is counted, in the chunks as in the calibration.

Cases: vectors that are null, empty, zero, of another length than most of the sample, or that hold
null or non-finite components take no part, as queries or as candidates; nor do rows without vec_id.
Repeated rows of one vec_id count once as neighbours, with the least distance, and once as a query,
with the least of their vectors. Equal distances go to the smaller vec_id. With fewer candidates than asked for, all are
returned. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm import common

TREES, LEAF_ROWS, SAMPLE_ROWS = 6, 128, 10_000
#: Sampled rows of a leaf that is parted again and the fewest a split is taken from; most leaves, levels.
SPLIT_SAMPLE, LEAST_SAMPLE, MOST_LEAVES, MOST_LEVELS = 2048, 32, 1 << 21, 40
NEAREST, QUERY_STEP = 10, 100
CALIBRATION_QUERIES, RECALL = 96, 0.96
CHUNK_ROWS, ASKED_ROWS = 512, 512
#: Rows of a query's first leaves, whose k-th distance bounds what its other leaves give back.
FIRST_ROWS = 2048


def splits_of(along: np.ndarray, held: float, leaf_rows: int) -> list[tuple[int, float]]:
    """(place, split) of the inner nodes of a subtree, in heap order from 1; `along` has a row's projection on
    each level's direction, and the node holds `held` rows of which these are a sample."""
    node, found = np.ones(len(along), np.int64), []
    for level in range(along.shape[1]):
        order = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(node[order]) != 0, [True])))
        parted = False
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            here = order[a:b]
            if (level and (node[here[0]] >> level) != 1) or b - a < LEAST_SAMPLE or held * (b - a) / len(along) <= leaf_rows:
                continue
            values = along[here, level]
            split = float(np.median(values))
            if not (values > split).any():  # at least half are equal
                lower = values[values < split]
                if not len(lower):
                    continue
                split = float(lower.max())
            found.append((int(node[here[0]]), split))
            node[here] = 2 * node[here] + (values > split)
            parted = True
        if not parted:
            break
    return found


class Forest:
    """Trees of splits in common arrays: the roots come first, a node's children stand side by side."""

    def __init__(self, size: int, trees: int = TREES, seed: int = 11):
        random = np.random.default_rng(seed)
        self.directions = random.normal(size=(trees, MOST_LEVELS, size))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.child = np.full(trees, -1, np.int32)
        self.split = np.zeros(trees)
        self.level = np.zeros(trees, np.int8)
        self.tree = np.arange(trees, dtype=np.int8)

    def __len__(self) -> int:
        return len(self.directions)

    @property
    def leaves(self) -> int:
        return int((self.child < 0).sum())

    def attach(self, found: list[tuple[int, list[tuple[int, float]]]]) -> None:
        """Subtrees (as of `splits_of`) in the place of leaves."""
        child, split, level, tree = ([x] for x in (self.child, self.split, self.level, self.tree))
        size = len(self.child)
        edits: list[tuple[int, int, float]] = []
        for root, splits in found:
            at = {1: root}
            depth = int(self.level[root])
            for place, value in splits:  # parents before children
                edits.append((at[place], size, value))
                at[2 * place], at[2 * place + 1] = size, size + 1
                new = depth + place.bit_length()
                child.append(np.full(2, -1, np.int32))
                split.append(np.zeros(2))
                level.append(np.full(2, new, np.int8))
                tree.append(np.full(2, self.tree[root], np.int8))
                size += 2
        self.child, self.split, self.level, self.tree = (np.concatenate(x) for x in (child, split, level, tree))
        for node, first, value in edits:
            self.child[node], self.split[node] = first, value

    def depth(self) -> int:
        return int(self.level.max())

    def along(self, vectors: np.ndarray) -> np.ndarray:
        """[tree, vector, level]: the projections on the directions in use."""
        return np.stack([vectors @ d[: self.depth()].T for d in self.directions])

    def file(self, vectors: np.ndarray, along: np.ndarray | None = None) -> np.ndarray:
        """[tree, vector]: the leaf."""
        along = self.along(vectors) if along is None else along
        node = np.repeat(np.arange(len(self))[:, None], len(vectors), axis=1)
        for level in range(self.depth()):
            child = self.child[node]
            node = np.where(child >= 0, child + (along[:, :, level] > self.split[node]), node)
        return node

    def walk(self, along: np.ndarray) -> Iterator[int]:
        """Leaves of all trees, nearest first; `along` is [tree, level] of one query."""
        queue = [(0.0, t) for t in range(len(self))]
        own, child, split, level, tree = along.tolist(), self.child, self.split, self.level, self.tree
        while queue:
            beyond, node = heapq.heappop(queue)
            while (first := int(child[node])) >= 0:
                m = own[tree[node]][level[node]] - float(split[node])
                heapq.heappush(queue, (beyond + m * m, first + (m <= 0)))
                node = first + (m > 0)
            yield node


def closest(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, exact distances and places of the k nearest by (distance, id), the query's own id
    left out; an id met more than once counts with its nearest row."""
    rough = ((vectors - query) ** 2).sum(axis=1)
    rough[ids == query_id] = np.inf
    rows = k
    while True:
        at = np.flatnonzero(rough <= np.partition(rough, rows - 1)[rows - 1]) if len(ids) > rows else np.arange(len(ids))
        at = at[np.isfinite(rough[at])]
        at = at[np.lexsort((ids[at], rough[at]))]
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])]
        if len(at) >= k or rows >= len(ids):
            break
        rows *= 4
    at = at[:k]
    return ids[at], np.sqrt(rough[at]), at


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part (their length is checked against the sample's later)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _stirred(ids: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Hashes of ids, another for each salt."""
    x = ids.astype(np.int64).view(np.uint64) + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in (0x7FB5D329728EA185, 0x81DADEF4BC2DD44D):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(k)
    return x ^ (x >> np.uint64(33))


def _row_hashes(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A hash of each row's id and vector."""
    return _stirred(ids, (vectors.view(np.uint64) * np.arange(1, 2 * vectors.shape[1], 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))


def _leaf_counts(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Rows of each node; a number for each leaf is all that comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, n = np.unique(forest.file(matrix(batch.column(1))), return_counts=True)
                yield _batch({"leaf": pa.array(leaf), "n": pa.array(n.astype(np.int64))})

    return _by_leaf(rows.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")), forest)


def _by_leaf(counts: DataFrame, forest: Forest) -> np.ndarray:
    got = counts.toArrow()
    held = np.zeros(len(forest.child), np.int64)
    held[got.column("leaf").to_numpy()] = got.column("n").to_numpy()
    return held


def grow(rows: DataFrame, sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> tuple[Forest, np.ndarray]:
    """A forest for vec_id, v of `rows`, and the rows that each of its leaves holds."""
    forest, total = Forest(sample.shape[1], trees), rows.count()
    levels = max(1, int(np.ceil(np.log2(max(2.0, len(sample) / LEAST_SAMPLE)))))
    forest.attach([(t, splits_of(sample @ forest.directions[t, :levels].T, total, leaf_rows)) for t in range(trees)])
    held = _leaf_counts(rows, forest)
    final: set[int] = set()
    while forest.leaves < MOST_LEAVES:
        crowded = [n for n in np.flatnonzero(held > 2 * leaf_rows).tolist() if n not in final and forest.level[n] < MOST_LEVELS]
        if not crowded:
            break
        crowded.sort(key=lambda n: -held[n])
        gains = np.cumsum(held[crowded] // leaf_rows)
        crowded = crowded[: max(1, int(np.searchsorted(gains, MOST_LEAVES - forest.leaves, "right")))]
        share = np.zeros(len(held))
        share[crowded] = SPLIT_SAMPLE / held[crowded]
        found = _fit_leaves(rows, forest, held, share, leaf_rows)
        final.update(n for n in crowded if not found.get(n))
        forest.attach([(n, splits) for n, splits in found.items() if splits])
        held = _leaf_counts(rows, forest)
    return forest, held


def _fit_leaves(rows: DataFrame, forest: Forest, held: np.ndarray, share: np.ndarray, leaf_rows: int) -> dict[int, list[tuple[int, float]]]:
    """Splits of the leaves with a share, each fitted in a task on that share of its rows."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(1))
                leaf, key = forest.file(vectors), _row_hashes(batch.column(0).to_numpy(), vectors)
                t, i = np.nonzero((key >> np.uint64(11)) / float(1 << 53) < share[leaf])
                yield _batch({"leaf": pa.array(leaf[t, i]), "v": batch.column(1).take(pa.array(i))})

    def fit(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        level = int(forest.level[leaf])
        levels = min(MOST_LEVELS - level, int(np.ceil(np.log2(SPLIT_SAMPLE / LEAST_SAMPLE))))
        found = splits_of(matrix(table.column("v")) @ forest.directions[forest.tree[leaf], level : level + levels].T, float(held[leaf]), leaf_rows)
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "place": pa.array([[p for p, _ in found]], pa.list_(pa.int64())), "split": pa.array([[s for _, s in found]], pa.list_(pa.float64()))})

    kind = rows.schema["v"].dataType.simpleString()
    got = rows.mapInArrow(sampled, f"leaf long, v {kind}").groupBy("leaf").applyInArrow(fit, "leaf long, place array<long>, split array<double>").toArrow()
    return {n: list(zip(p, s, strict=True)) for n, p, s in zip(*(got.column(c).to_pylist() for c in ("leaf", "place", "split")), strict=True)}


def nearest(embeddings: DataFrame, *, k: int = NEAREST, query_step: int = QUERY_STEP, trees: int = TREES, recall: float = RECALL, chunk_rows: int = CHUNK_ROWS, leaf_rows: int = LEAF_ROWS, least_search: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query (vec_id divisible by query_step).
    `least_search` is a floor under the measured number of rows searched."""
    rows = usable(embeddings)
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sample = common.bounded_sample(rows, "vec_id", SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    sizes = sample.column("v").combine_chunks().value_lengths().to_numpy()
    size = int(np.bincount(sizes).argmax())
    rows = common.materialize(rows.where(F.size("v") == size).distinct(), "vectors")
    forest, held = grow(rows, matrix(sample.column("v").filter(pa.array(sizes == size))), trees, leaf_rows)
    queries = rows.where(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    search_rows = max(least_search, _calibrate(rows, queries, forest, held, k, recall))
    kind = rows.schema["v"].dataType.simpleString()

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = forest.along(matrix(batch.column(1)))
            at, leaves, turns = [], [], []
            for i in range(batch.num_rows):
                total = 0
                for leaf in forest.walk(along[:, i]):
                    if held[leaf]:
                        at.append(i)
                        leaves.append(leaf)
                        turns.append(int(total >= FIRST_ROWS))
                        total += held[leaf]
                    if total >= search_rows:
                        break
            yield _batch({"leaf": pa.array(leaves, pa.int64()), "query_id": batch.column(0).take(pa.array(at, pa.int64())), "turn": pa.array(turns, pa.int32())})

    asked = common.materialize(queries.mapInArrow(probes, "leaf long, query_id long, turn int"), "probes")
    vectors_of = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    first = common.materialize(_searched(rows, asked.where("turn = 0"), vectors_of.withColumn("bound", F.lit(float("inf"))), forest, held, k, chunk_rows), "first-neighbours")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = first.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    bounded = vectors_of.join(best.select("query_id", F.col("score").alias("bound")), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    others = _searched(rows, asked.where("turn = 1"), bounded, forest, held, k, chunk_rows)
    distinct = first.unionByName(others).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, asked: DataFrame, queries: DataFrame, forest: Forest, held: np.ndarray, k: int, chunk_rows: int) -> DataFrame:
    """query_id, vec_id, score: of each leaf and chunk asked for, the k nearest rows that are not farther than the query's
    bound. `asked` has leaf and query_id, `queries` query_id, q and bound."""
    kind = rows.schema["v"].dataType.simpleString()
    chunks = np.maximum(1, -(-held // chunk_rows))
    parts = -(-_by_leaf(asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), forest) // ASKED_ROWS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates, once for each part of their leaf's queries; those of leaves not asked for go."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(1))
            leaf = forest.file(vectors)
            key = _row_hashes(batch.column(0).to_numpy(), vectors)
            times = parts[leaf].reshape(-1)
            at = np.repeat(np.arange(leaf.size), times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            leaf, row = leaf.reshape(-1)[at], at % batch.num_rows
            chunk = (key[row] % chunks[leaf].astype(np.uint64)).astype(np.int32)
            yield _batch({"leaf": pa.array(leaf), "chunk": pa.array(chunk), "part": pa.array(part.astype(np.int32)), "vec_id": batch.column(0).take(pa.array(row)), "v": batch.column(1).take(pa.array(row))})

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, once for each chunk of the leaf they ask."""
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            part = (_stirred(batch.column(1).to_numpy(), leaf) % np.maximum(parts[leaf], 1).astype(np.uint64)).astype(np.int32)
            at = np.repeat(np.arange(len(leaf)), chunks[leaf])
            chunk = np.arange(len(at)) - np.repeat(np.cumsum(chunks[leaf]) - chunks[leaf], chunks[leaf])
            where = pa.array(at)
            yield _batch({"leaf": pa.array(leaf[at]), "chunk": pa.array(chunk.astype(np.int32)), "part": pa.array(part[at]), "query_id": batch.column(1).take(where), "q": batch.column(2).take(where), "bound": batch.column(3).take(where)})

    def rerank(found: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if found.num_rows and asks.num_rows:
            ids, vectors = found.column("vec_id").to_numpy(), matrix(found.column("v"))
            for q, v, bound in zip(asks.column("query_id").to_pylist(), matrix(asks.column("q")), asks.column("bound").to_pylist(), strict=True):
                near, far, _ = closest(ids, vectors, v, q, k)
                out.append((q, near[far <= bound], far[far <= bound]))
        join = lambda i, t: np.concatenate([o[i] for o in out]) if out else np.zeros(0, t)
        return pa.table({"query_id": pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int64()), "vec_id": pa.array(join(1, np.int64)), "score": pa.array(join(2, np.float64))})

    group = ["leaf", "chunk", "part"]
    kept = rows.mapInArrow(dealt, f"leaf long, chunk int, part int, vec_id long, v {kind}")
    wanted = asked.join(queries, "query_id").select("leaf", "query_id", "q", "bound").mapInArrow(asking, f"leaf long, chunk int, part int, query_id long, q {kind}, bound double")
    return kept.groupBy(*group).cogroup(wanted.groupBy(*group)).applyInArrow(rerank, "query_id long, vec_id long, score double")


def _calibrate(rows: DataFrame, queries: DataFrame, forest: Forest, held: np.ndarray, k: int, recall: float) -> int:
    """How many rows a query has to search for the share `recall` of true neighbours to be among them."""
    asked = common.bounded_sample(queries, "vec_id", CALIBRATION_QUERIES).toArrow()
    if not asked.num_rows:
        return 0
    ids, vectors = asked.column("vec_id").to_numpy(), matrix(asked.column("v"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, all_ = matrix(batch.column(1)), batch.column(0).to_numpy()
            leaves = forest.file(own).T
            found = [closest(all_, own, v, q, k) for q, v in zip(ids, vectors, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(leaves[np.concatenate([f[2] for f in found])].tolist(), pa.list_(pa.int64()))],
                names=["query_id", "vec_id", "score", "leaves"],
            )

    near = rows.mapInArrow(exact, "query_id long, vec_id long, score double, leaves array<long>")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min(F.struct("score", "leaves")).alias("best")).select("query_id", "vec_id", "best.*")
    truth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "leaves").collect()
    along, place = forest.along(vectors), {int(q): i for i, q in enumerate(ids)}
    missing: dict[int, list[set[int]]] = {}
    for r in truth:
        missing.setdefault(r["query_id"], []).append(set(r["leaves"]))
    needed = []
    for q, left in missing.items():  # a walk ends when a leaf of each of the query's neighbours was met
        total = 0
        for leaf in forest.walk(along[:, place[q]]):
            total += int(held[leaf])
            met = [leaves for leaves in left if leaf in leaves]
            if met:
                needed += [total] * len(met)
                left = [leaves for leaves in left if leaf not in leaves]
            if not left:
                break
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
