"""Documents joined by the Jaccard similarity of their word n-grams: a sparse matrix product in blocks.

The matrix has a row for each distinct set (documents with equal sets are one node) and a column for each
n-gram. Entry (x, y) of its product with its transpose is the overlap of two sets, and sets are linked when

    100 * overlap >= percent * (size_x + size_y - overlap).

Only entries that can reach that bound are computed. Columns have one fixed order, rare ones first. Two linked sets
share a column among the first `size - ceil(percent / 100 * size) + 1` of each (its prefix), and with the
first shared column at places i and j their overlap is min(size_x - i, size_y - j) at most: pairs for which this bound
is too low are discarded before any set is read.

The order of columns is, first, a class: every column is hashed to one of CELLS counters over all documents, and the
counters, from light to heavy, hold the first quarter, half, three quarters, ... of all n-grams. A node sends the columns
of as many classes as it takes to fill its prefix. Within a class a column comes the earlier the fewer nodes
sent it; so its place in a node's order is the same function of the column everywhere, and prefixes are true
prefixes although most n-grams are never shuffled. Columns that only one node sent lead to nobody and fall out.

The product is then taken block by block. In each round every shared column names a pivot (the node met most in
shared columns), and the other nodes of the column, if of another component, are multiplied with the pivot's row: one
block is a pivot and as many rows as BLOCK_WEIGHT allows. Linked nodes join components. After ROUNDS rounds, columns that
still hold several components are dealt by size into classes of which only neighbours can be linked, classes to
blocks, and blocks are multiplied with blocks. Inside a block overlaps are summed over slices of columns, rows of which
no pair can reach its bound any more are dropped between slices, and only a spanning forest of the links found leaves
the task. So groups of near copies are never expanded into pairs, and no link is lost for the components.

Before rows are multiplied their parities are compared: the set folded by XOR into a bitmap of about BITS bits for each
member. Two bitmaps never differ in more bits than the sets have different members, so a count over what the
similarity allows rules a pair out for certain; whole sets are read for the others alone.

Cases: a null text, or one without words, has an empty set and is linked with nothing. Repeated rows are one node and
share a component. A row without doc_id is linked as any other, but a null is a component's id only if all its doc_ids
are null. Sets of equal size and similarity just at the bound are linked. Very long texts are one row of the matrix
like all others; one whose set outweighs a block is a block of its own. Extra columns are ignored. An empty table
gives an empty result. Columns are told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm import common, components
from veilspan.llm.bitmaps import bitmap, in_bitmap
from veilspan.llm.features import _words
from veilspan.llm.fingerprints import stir

WORDS, PERCENT = 3, 90
#: Counters of the column classes, and columns that a node sends beyond its prefix at least.
CELLS, SPARE = 1 << 16, 2
ROUNDS = 4
#: N-grams of one side of a block, and the least that one row counts for (so that a block has 512 rows at most).
BLOCK_WEIGHT, ROW_WEIGHT = 1 << 20, 1 << 11
#: Columns of a block's slice.
SLICE = 4096
#: Bits of a parity for each member, and the fewest of all.
BITS, LEAST_BITS = 4, 2048

_SEED = np.uint64(0x8CB92BA72F3D8DD7)
_TIMES = np.uint64(0xD1342543DE82EF95)


def ngrams(text: str | None, size: int) -> np.ndarray:
    """Ascending hashes of a text's distinct word n-grams; with fewer words, of the whole sequence."""
    words = _words(np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8))
    n = min(len(words), size)
    if not n:
        return np.zeros(0, np.int64)
    words = stir(words)
    joined = np.full(len(words) - n + 1, _SEED + np.uint64(n), np.uint64)
    for i in range(n):
        joined = joined * _TIMES + words[i : len(words) - n + 1 + i]
    return np.unique(stir(joined).view(np.int64))


def set_hash(members: np.ndarray) -> int:
    """A 64-bit hash of a set that is not empty."""
    return int(stir(stir(members.view(np.uint64) ^ _SEED).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(members))).view(np.int64)[0])


def parity(members: np.ndarray) -> bytes:
    """The set folded into a bitmap by XOR. Its halves XORed are the bitmap of half the size."""
    bits = max(LEAST_BITS, 1 << (BITS * len(members) - 1).bit_length())
    places = (stir(members.view(np.uint64) + _TIMES) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).tobytes()


def parities(found: list[bytes], size: int) -> np.ndarray:
    """[row, 64-bit word]: parities folded to `size` bytes each."""
    out = np.zeros((len(found), size // 8), np.uint64)
    for i, data in enumerate(found):
        words = np.frombuffer(data, np.uint64)
        while len(words) > size // 8:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[i] = words
    return out


def may_be_near(left: list[bytes], right: list[bytes], sizes_left: np.ndarray, sizes_right: np.ndarray, percent: int) -> np.ndarray:
    """[left, right]: whether parities allow the similarity."""
    size = min(map(len, (*left, *right)))
    a, b = parities(left, size), parities(right, size)
    differing = np.zeros((len(a), len(b)), np.int64)
    for i in range(size // 8):
        differing += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return (100 + percent) * differing <= (100 - percent) * (sizes_left[:, None] + sizes_right[None, :])


def least_overlap(size_x, size_y, percent: int):
    """The smallest overlap of two sets of these sizes that is a link."""
    return -(-percent * (size_x + size_y) // (100 + percent))


def prefix_length(size, percent: int):
    """Columns of a set of which a linked set has at least one among its own."""
    return size + percent * size // -100 + 1


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, row (equal rows share it), text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, row, n, node (hash of the set, null when empty) of every row; and for each task a row with `counts` alone,
    the n-grams that its documents have in each counter."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(CELLS, np.int64), ["doc_id", "row", "n", "node", "counts"]
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(2):
                found = ngrams(text.as_py(), size)
                counts += np.bincount(_cells(found), minlength=CELLS)
                sizes.append(len(found))
                nodes.append(set_hash(found) if len(found) else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(sizes), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in names[:4]), pa.array([counts], pa.list_(pa.int64()))], names=names)

    return _rows(documents).mapInArrow(sign, "doc_id long, row long, n long, node long, counts array<long>")


def _cells(members: np.ndarray) -> np.ndarray:
    return (members.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))


def column_classes(counted: DataFrame) -> np.ndarray:
    """The class of each counter, from the number of n-grams that all documents have in it."""
    cells = counted.where("counts is not null").select(F.posexplode("counts").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CELLS, np.int64)
    for r in cells.collect():  # CELLS rows
        counts[r["cell"]] = r["n"]
    order = np.argsort(counts, kind="stable")
    share = np.concatenate(([0], np.cumsum(counts[order])[:-1])) / max(counts.sum(), 1)
    classes = np.zeros(CELLS, np.uint8)
    classes[order] = np.where(share < 0.75, share * 4, np.minimum(1 - np.log2(np.maximum(1 - share, 2.0**-20)), 20)).astype(np.uint8)
    return classes


def _of_rows(documents: DataFrame, firsts: DataFrame, size: int, kept: str, make) -> DataFrame:
    """What `make` yields for node, n-grams of the rows that `firsts` names (a bitmap keeps most others out before a set is
    made; what uses these rows is exact whatever it lets pass). No text is shuffled."""
    bits = bitmap(firsts, "row")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy())))
            yield make([(set_hash(f), f) for f in (ngrams(t.as_py(), size) for t in texts) if len(f)])

    return _rows(documents).select("row", "text").mapInArrow(build, kept)


def sent_columns(documents: DataFrame, firsts: DataFrame, size: int, classes: np.ndarray, percent: int) -> DataFrame:
    """node, n, class, before (the node's columns in earlier classes), own (those in this one), columns: a row for each class
    that a node sends."""

    def send(sets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        out = []
        for node, members in sets:
            own = classes[_cells(members)]
            sizes = np.bincount(own)
            ends = np.cumsum(sizes)
            last = int(np.searchsorted(ends, min(prefix_length(len(members), percent) + SPARE, len(members))))
            out += [(node, len(members), int(c), int(ends[c] - sizes[c]), int(sizes[c]), members[own == c]) for c in np.flatnonzero(sizes[: last + 1])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(_SENT.values())], names=list(_SENT))

    return _of_rows(documents, firsts, size, "node long, n long, class int, before long, own long, columns array<long>", send)


_SENT = {"node": pa.int64(), "n": pa.int64(), "class": pa.int32(), "before": pa.int64(), "own": pa.int64(), "columns": pa.list_(pa.int64())}


def _met(sent: DataFrame, several: DataFrame) -> DataFrame:
    """node, n, class, before, own, column, nodes of the sent columns that several nodes sent. A bitmap keeps most of the
    others out before there is a row for each."""
    bits = bitmap(several, "column")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [columns[in_bitmap(bits, columns)] for columns in _lists(batch.column(5))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(kept, pa.list_(pa.int64()))], names=list(_SENT))

    found = sent.mapInArrow(keep, sent.schema)
    return found.select("node", "n", "class", "before", "own", F.explode("columns").alias("column")).join(several, "column")


def full_sets(documents: DataFrame, firsts: DataFrame, size: int) -> DataFrame:
    """node, parity, members of the nodes whose rows `firsts` names."""

    def whole(sets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        columns = [pa.array([n for n, _ in sets], pa.int64()), pa.array([parity(m) for _, m in sets], pa.binary()), pa.array([m for _, m in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "parity", "members"])

    found = _of_rows(documents, firsts, size, "node long, parity binary, members array<long>", whole)
    return found.join(firsts.select("node"), "node", "left_semi").dropDuplicates(["node"])


def shared_prefixes(documents: DataFrame, firsts: DataFrame, size: int, classes: np.ndarray, percent: int) -> DataFrame:
    """column, node, n, place: the prefix entries of columns that several nodes have in their prefix."""
    sent = common.materialize(sent_columns(documents, firsts, size, classes, percent), "sent-columns")
    several = common.materialize(sent.select(F.explode("columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "shared-columns")
    met = _met(sent, several)
    met = met.repartition("node", "class").dropDuplicates(["node", "class", "column"])
    of_class = Window.partitionBy("node", "class")  # one document's n-grams at most
    alone = F.col("own") - F.count(F.lit(1)).over(of_class)
    place = F.col("before") + alone + F.row_number().over(of_class.orderBy("nodes", "column")) - 1
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    placed = common.materialize(met.withColumn("place", place).where(F.col("place") < prefix).select("column", "node", "n", "place"), "prefixes")
    common.discard(sent, several)
    wide = placed.groupBy("column").agg(F.count(F.lit(1)).alias("present")).where("present > 1")
    kept = common.materialize(placed.join(wide, "column"), "shared-prefixes")
    common.discard(placed)
    return kept


def _may_link(n_x: str, place_x: str, n_y: str, place_y: str, percent: int) -> Column:
    most = F.least(F.col(n_x) - F.col(place_x), F.col(n_y) - F.col(place_y))
    return (100 + percent) * most >= percent * (F.col(n_x) + F.col(n_y))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """[left, right]: the overlaps of sets, or fewer where they are no link: the product of two blocks, slice by slice."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    wanted = least_overlap(sizes[0][:, None], sizes[1][None, :], percent)
    rows = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes, strict=True)]
    values = [np.concatenate(side) for side in (left, right)]
    columns = np.intersect1d(np.unique(values[0]), np.unique(values[1]))
    for s in (0, 1):
        place = np.searchsorted(columns, values[s])
        both = (place < len(columns)) & (columns[np.minimum(place, len(columns) - 1)] == values[s]) if len(columns) else np.zeros(len(place), bool)
        order = np.argsort(place[both], kind="stable")
        rows[s], values[s] = rows[s][both][order], place[both][order]
    rest = [np.bincount(r, minlength=len(n)) for r, n in zip(rows, sizes, strict=True)]
    counts = np.zeros(wanted.shape, np.int64)
    for at in range(0, len(columns), SLICE):
        alive = counts + np.minimum(rest[0][:, None], rest[1][None, :]) >= wanted
        live = alive.any(axis=1), alive.any(axis=0)
        if not live[0].any():
            break
        dense = []
        for s in (0, 1):
            a, b = np.searchsorted(values[s], (at, at + SLICE))
            row, column = rows[s][a:b], values[s][a:b] - at
            rest[s] = rest[s] - np.bincount(row, minlength=len(rest[s]))
            number, own = np.cumsum(live[s]) - 1, live[s][row]
            part = np.zeros((int(live[s].sum()), min(SLICE, len(columns) - at)), np.float32)
            part[number[row[own]], column[own]] = 1
            dense.append(part)
        counts[np.ix_(*live)] += (dense[0] @ dense[1].T).astype(np.int64)
    return counts


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the pairs that a spanning forest of them needs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(i)
    return kept


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list]]]:
    """block and its rows: the other columns as Python values, lists as arrays."""
    now, rows = None, []
    for batch in batches:
        columns = [_lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns[1:]]
        for key, *row in zip(batch.column(0).to_pylist(), *columns, strict=True):
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append([v.copy() if isinstance(v, np.ndarray) else v for v in row])
    if rows:
        yield now, rows


def _sides(rows: list[list]) -> tuple[list[list], list[list]]:
    """The rows of both sides; a block with one side only is compared with itself."""
    left, right = ([r for r in rows if r[0] == s] for s in (0, 1))
    return left or right, right or left


def _in_blocks(blocks: DataFrame, *columns: str) -> DataFrame:
    return blocks.select("block", "side", "node", "root", *columns).repartition("block").sortWithinPartitions("block", "side")


def multiply(blocks: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links of each block.

    `blocks` has block (array<long>), side (0 or 1), node, root, members; nodes of both sides are compared if their
    roots differ, or all of them with one another if the block has one side only."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches):
            left, right = _sides(rows)
            found = overlaps([r[3] for r in left], [r[3] for r in right], percent)
            sizes = [np.array([len(r[3]) for r in side]) for side in (left, right)]
            roots = [np.array([r[2] for r in side]) for side in (left, right)]
            i, j = np.nonzero((found >= least_overlap(sizes[0][:, None], sizes[1][None, :], percent)) & (roots[0][:, None] != roots[1][None, :]))
            a, b = np.array([r[1] for r in left], np.int64)[i], np.array([r[1] for r in right], np.int64)[j]
            kept = _forest(a, b)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(a[kept], pa.int64()), pa.array(b[kept], pa.int64())], names=["a", "b"])

    return _in_blocks(blocks, "members").mapInArrow(product, "a long, b long")


def near_rows(blocks: DataFrame, percent: int) -> DataFrame:
    """block, side, node, root of the rows that may be linked with one of the other side and of another root.

    `blocks` has n, place (of the block's column) and parity besides."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            left, right = _sides(rows)
            sizes, rest, roots = ([np.array([f(r) for r in side], np.int64) for side in (left, right)] for f in (lambda r: r[3], lambda r: r[3] - r[4], lambda r: r[2]))
            most = np.minimum(rest[0][:, None], rest[1][None, :])
            open_ = (roots[0][:, None] != roots[1][None, :]) & (most >= least_overlap(sizes[0][:, None], sizes[1][None, :], percent))
            if open_.any():
                open_ &= may_be_near([r[5] for r in left], [r[5] for r in right], *sizes, percent)
            kept = [r for r, o in zip(left, open_.any(axis=1), strict=True) if o]
            kept += [r for r, o in zip(right, open_.any(axis=0), strict=True) if o and left is not right]
            if kept:
                columns = [pa.array([block] * len(kept), pa.list_(pa.int64())), *(pa.array([r[i] for r in kept], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "side", "node", "root"])

    return _in_blocks(blocks, "n", "place", "parity").mapInArrow(near, "block array<long>, side int, node long, root long")


def near_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """pivot, node, n of the pairs (with pivot_n, parity and pivot_parity besides) that parities allow."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(i).to_numpy() for i in (2, 3)]
            kept = [may_be_near([a], [b], m, n, percent)[0, 0] for a, b, m, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), sizes[0][:, None], sizes[1][:, None], strict=True)]
            yield batch.select(["pivot", "node", "n"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("pivot", "node", "n", "pivot_n", "parity", "pivot_parity").mapInArrow(near, "pivot long, node long, n long")


def _weight() -> Column:
    return F.greatest(F.col("n"), F.lit(ROW_WEIGHT))


def _stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of pivots with nodes: `pairs` has pivot, pivot_n, node, n."""
    parity_of = sets.select("node", "parity")
    both = pairs.distinct().join(parity_of, "node").join(parity_of.select(F.col("node").alias("pivot"), F.col("parity").alias("pivot_parity")), "pivot")
    pairs = common.materialize(near_pairs(both, percent), "pivot-pairs")
    parts = pairs.groupBy("pivot").agg(F.ceil(F.sum(_weight()) / BLOCK_WEIGHT).alias("parts"))
    dealt = pairs.join(parts, "pivot").select("node", F.array("pivot", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"), F.lit(1).alias("side"))
    pivots = parts.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = dealt.unionByName(pivots.select("node", F.array("node", "part").alias("block"), F.lit(0).alias("side")))
    found = common.materialize(multiply(dealt.join(sets.select("node", "members"), "node").withColumn("root", F.col("side").cast("long")), percent), "pivot-links")
    common.discard(pairs)
    return found


def _rest(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within a column, block against block."""
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-6  # linked sizes are one class apart at most
    rows = active.withColumn("class", F.floor(F.log("n") / step))
    held = rows.groupBy("column", "class").agg(F.ceil(F.sum(_weight()) / BLOCK_WEIGHT).alias("parts"))
    rows = rows.join(held, ["column", "class"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    above = held.select("column", (F.col("class") - 1).alias("class"), F.col("parts").alias("parts_above"))
    below = held.select("column", (F.col("class") + 1).alias("class"), F.col("parts").alias("parts_below"))
    rows = rows.join(above, ["column", "class"], "left").join(below, ["column", "class"], "left")
    every = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    own, kind = F.col("part"), F.col("class")
    within = F.transform(every(F.col("parts")), lambda o: F.struct(F.array("column", kind, F.least(own, o), kind, F.greatest(own, o)).alias("block"), (own > o).cast("int").alias("side")))
    up = F.transform(every(F.col("parts_above")), lambda o: F.struct(F.array("column", kind, own, kind + 1, o).alias("block"), F.lit(0).alias("side")))
    down = F.transform(every(F.col("parts_below")), lambda o: F.struct(F.array("column", kind - 1, o, kind, own).alias("block"), F.lit(1).alias("side")))
    none = F.filter(within, lambda x: F.lit(False))
    dealt = rows.select("node", "root", "n", "place", F.explode(F.concat(within, F.coalesce(up, none), F.coalesce(down, none))).alias("at"))
    near = near_rows(dealt.select("node", "root", "n", "place", "at.block", "at.side").join(sets.select("node", "parity"), "node"), percent)
    return multiply(common.materialize(near, "near-rows").join(sets.select("node", "members"), "node"), percent)


def _components(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root of the nodes that links join; `shared` is as of `shared_prefixes`."""
    weights = common.materialize(shared.groupBy("node").agg(F.sum("present").alias("weight")), "column-weights")
    left = shared.join(weights, "node").select("column", "node", "n", "place", "weight")
    roots, links, active = shared.sparkSession.createDataFrame([], "node long, root long"), None, None
    for step in range(ROUNDS + 1):
        labelled = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = F.max_by(F.struct("node", "root", "n", "place"), F.struct("weight", "node")).alias("pivot")
        open_ = labelled.groupBy("column").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        named = open_.select("column", *(F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("node", "root", "n", "place")))
        last, active = active, common.materialize(labelled.join(named, "column"), "open-columns")
        if last is not None:
            common.discard(last)
        if active.isEmpty():
            break
        if step < ROUNDS:
            apart = active.where("root <> pivot_root").where(_may_link("n", "place", "pivot_n", "pivot_place", percent))
            found = _stars(apart.select(F.col("pivot_node").alias("pivot"), "pivot_n", "node", "n"), sets, percent)
        else:
            found = common.materialize(_rest(active, sets, percent), "block-links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            earlier, roots = roots, components.roots(links)
            if hasattr(earlier, "scratch_path"):
                common.discard(earlier)
        left = active.where("node <> pivot_node").select("column", "node", "n", "place", "weight")
    common.discard(weights)
    return roots


def join(documents: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `documents`, linked from `percent` similar n-grams on."""
    if not 1 <= percent <= 100:
        raise ValueError(f"similarity of {percent} percent")
    signed = common.materialize(signatures(documents, words), "ngram-signatures")
    rows = signed.where("counts is null")
    nodes = common.materialize(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")), "ngram-nodes")
    shared = shared_prefixes(documents, nodes, words, column_classes(signed), percent)
    linked = shared.select("node").distinct()
    full = common.materialize(full_sets(documents, common.materialize(nodes.join(linked, "node", "left_semi"), "linked-nodes"), words), "full-sets")
    roots = _components(shared, full, percent)
    common.discard(full, shared)

    of_root = nodes.join(roots, "node").groupBy("root").agg(F.min("first").alias("joined"))
    of_root = of_root.join(nodes.select(F.col("node").alias("root"), F.col("first").alias("own")), "root").select("root", F.least("joined", "own").alias("component"))
    named = roots.join(of_root, "root").select("node", "component").unionByName(of_root.select(F.col("root").alias("node"), "component"))
    classes = nodes.join(named, "node", "left").select("node", F.coalesce("component", "first").alias("component_id"))
    out = rows.select("doc_id", "n", "node").join(classes, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), 90, 3)


#: Brute force: all pairs that share an n-gram, counted on the n-grams themselves.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM worded
), items AS (SELECT doc_id, md5_number(unnest(s)) AS x FROM sets),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT r.a AS doc_id, any_value(n) AS n_shingles, min(r.b) AS component_id
FROM reach r JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""
