"""Near-duplicate documents by MinHash bands, with odd sketches to verify candidates.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents with equal sets
are one node. MinHash values of a set (Plan.samples) are cut into bands whose hashes file the node in
buckets, and are folded into a parity bitmap (odd sketch): the XOR of two bitmaps has few bits set
when few of the samples differ, so its population count tells at once which candidates cannot be
similar enough. A second, wider bitmap folds the whole set: its XOR never has more bits set than the
sets have different members, so a count over the number that the similarity allows rules a pair out
for certain, and for sets of a few thousand shingles hardly a dissimilar pair passes. Candidates that
pass both are confirmed on the full sets.

Buckets are never expanded into pairs. In each round every bucket names a pivot, the member met most
often in all buckets (the likely centre of its group); its other members are compared with the pivot
alone, and links found join components. A bucket with all its members in one component is finished;
after ROUNDS rounds the members of unfinished buckets are compared block by block on their sketches,
and only pairs of different components that the sketches accept leave a task.

The similarity is a parameter (`link`, `keep_one`) of which a Plan derives the rest: as many bands that two
sets of just that similarity share none with a probability under 5e-7, a bound on the sketches' bits five
standard deviations wide, and the whole sets' bound; larger similarities are safer still. The query's
contract is 85 percent, the pipeline's stage takes 80.

Cases: a null text, or one without words, has an empty set and is linked with nothing. Repeated rows
are one node and share a component. A row without doc_id is linked as any other, but a null is never a
component's id unless all its doc_ids are null, and such rows are never `kept` (though `keep_one` lets
them pass). Extra columns are ignored by `link` and carried by `keep_one`, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common, components
from veilspan.llm.bitmaps import bitmap, in_bitmap
from veilspan.llm.features import _words

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 85
BAND_ROWS, MISSED, DEVIATIONS = 4, 5e-7, 5
#: 64-bit words of the bitmap of the samples and of the bitmap of the whole set.
SKETCH_WORDS, WHOLE_WORDS = 8, 32
ROUNDS, BLOCK = 4, 512

_WEIGHTS = np.random.default_rng(20_240_501).integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Plan:
    """What follows from the least similarity of a link, in percent: the bands, and `most_bits`, the most
    differing bits of two sample sketches that are still compared on full sets."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError(f"similarity of {percent} percent")
        self.percent, alike = percent, percent / 100
        self.bands = max(1, math.ceil(math.log(MISSED) / math.log1p(-(alike**BAND_ROWS)))) if percent < 100 else 1
        self.samples = self.bands * BAND_ROWS
        differing = self.samples * (1 - alike)
        self.most_bits = 2 * math.ceil(differing + DEVIATIONS * math.sqrt(differing * alike))
        random = np.random.default_rng(20_240_502)
        self.multiply = random.integers(1, 1 << 63, self.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = random.integers(0, 1 << 63, self.samples, dtype=np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The set: ascending distinct shingle hashes (signed 64-bit)."""
    if not text:
        return np.zeros(0, np.int64)
    words = _stir(_words(np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)))
    n = min(len(words), SHINGLE_WORDS)
    if not n:
        return np.zeros(0, np.int64)
    count = len(words) - n + 1
    joined = np.full(count, n, np.uint64)
    for i in range(n):
        joined += words[i : i + count] * _WEIGHTS[i]
    return np.unique(_stir(joined).view(np.int64))


def set_hash(members: np.ndarray) -> int:
    """A 64-bit hash of a set that is not empty: equal sets are one node."""
    weights = _stir(members.view(np.uint64) + np.uint64(len(members)))
    return int(_stir(weights.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def minhash(members: np.ndarray, plan: Plan) -> np.ndarray:
    """The plan's number of minima of the set under fixed multiply-add hashes."""
    x = members.view(np.uint64)
    least = np.full(plan.samples, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096, None] * plan.multiply + plan.add
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(-1, BAND_ROWS)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in rows.T:
        keys = _stir(keys + column)
    return keys.view(np.int64)


def _parity(members: np.ndarray, words: int) -> np.ndarray:
    places = (members % np.uint64(64 * words)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=64 * words).astype(np.uint8) & 1).view(np.int64)


def odd_sketch(samples: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The samples, each with its number, folded by parity into SKETCH_WORDS words, and then the whole
    set folded into WHOLE_WORDS words."""
    numbered = _stir(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.concatenate((_parity(numbered, SKETCH_WORDS), _parity(_stir(members.view(np.uint64)), WHOLE_WORDS)))


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, row (hash of doc_id and text: equal rows share it), text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")


def signatures(documents: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, row, n_shingles, node (hash of the set; null when empty), bands and sketch of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                members = shingles(text)
                sizes.append(len(members))
                if len(members):
                    samples = minhash(members, plan)
                    nodes.append(set_hash(members))
                    bands.append(band_keys(samples))
                    sketches.append(odd_sketch(samples, members))
                else:
                    nodes.append(None)
                    bands.append(None)
                    sketches.append(None)
            lists = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, lists), pa.array(sketches, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_shingles", "node", "bands", "sketch"])

    return _rows(documents).mapInArrow(sign, "doc_id long, row long, n_shingles long, node long, bands array<long>, sketch array<long>")


def _may_be_similar(plan: Plan) -> Column:
    """Whether sketch_a and sketch_b, of sets of size_a and size_b, allow the similarity."""
    bits = [F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_WORDS + WHOLE_WORDS)]
    different = (100 - plan.percent) * (F.col("size_a") + F.col("size_b"))
    return (sum(bits[1:SKETCH_WORDS], bits[0]) <= plan.most_bits) & ((100 + plan.percent) * sum(bits[SKETCH_WORDS + 1 :], bits[SKETCH_WORDS]) <= different)


def _pairs(first: str | Column, second: str | Column) -> list[Column]:
    first, second = F.col(first) if isinstance(first, str) else first, F.col(second) if isinstance(second, str) else second
    return [F.least(first, second).alias("a"), F.greatest(first, second).alias("b")]


def link(documents: DataFrame, similarity_percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `documents`."""
    plan = Plan(similarity_percent)
    signed = common.materialize(signatures(documents, plan), "signatures")
    filled = signed.where("node is not null")
    classes = common.materialize(filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")), "set-classes")
    one_each = filled.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    nodes = common.materialize(one_each, "set-nodes")
    filed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = common.materialize(filed.join(shared, "bucket"), "buckets")
    weights = common.materialize(buckets.groupBy("node").agg(F.sum("size").alias("weight")), "bucket-weights")
    members = common.materialize(buckets.select("bucket", "node").join(weights, "node"), "bucket-members")
    sketches = common.materialize(nodes.select("node", "sketch", "size").join(weights.select("node"), "node", "left_semi"), "sketches")
    common.discard(buckets, nodes)
    sets = _full_sets(documents, classes.join(weights.select("node"), "node", "left_semi"))
    links = _link_nodes(members, sketches, sets, plan)
    common.discard(sets, sketches, weights)

    rooted = classes.join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = rooted.where("root <> node").select("node", "root").join(named, "root").select("node", "component_id")
    of_own = classes.join(of_node, "node", "left").join(named.select(F.col("root").alias("node"), F.col("component_id").alias("own")), "node", "left")
    found = of_own.select("node", F.coalesce("component_id", "own").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, members of the wanted nodes, from the row that `wanted` names for each. A bitmap of the row keys
    keeps other rows out before any set is made, and no text is shuffled."""
    bits = bitmap(wanted, "row")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(in_bitmap(bits, batch.column(0).to_numpy())))
            found = [f for f in (shingles(t.as_py()) for t in texts) if len(f)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "members"])

    rows = _rows(documents).select("row", "text").mapInArrow(members, "node long, members array<long>")
    return common.materialize(rows.dropDuplicates(["node"]), "full-sets")


def _confirm(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Of candidate pairs (a, b), repeats allowed, those that are links."""
    of = lambda t, n, *columns: t.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns])
    near = pairs.distinct().join(of(sketches, "a", "sketch", "size"), "a").join(of(sketches, "b", "sketch", "size"), "b")
    near = near.where(_may_be_similar(plan)).select("a", "b")
    full = near.join(of(sets, "a", "members"), "a").join(of(sets, "b", "members"), "b")
    common_ = F.size(F.array_intersect("members_a", "members_b")).cast("long")
    union = F.size("members_a") + F.size("members_b") - common_
    return full.where(100 * common_ >= plan.percent * union).select("a", "b")


def _link_nodes(members: DataFrame, sketches: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """node, root of the nodes that links join."""
    links = None
    roots = members.sparkSession.createDataFrame([], "node long, root long")
    active = left = members
    for step in range(ROUNDS + 1):
        labelled = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = labelled.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot"), F.max_by("root", F.struct("weight", "node")).alias("pivot_root"), F.count(F.lit(1)).alias("present"), F.min("root").alias("low"), F.max("root").alias("high"))
        last, active = active, common.materialize(labelled.join(open_.where("low <> high").drop("low", "high"), "bucket"), "open-buckets")
        common.discard(last)
        if active.isEmpty():
            break
        apart = active.where("root <> pivot_root").select(*_pairs("node", "pivot")) if step < ROUNDS else _blocks(active, sketches, plan)
        found = common.materialize(_confirm(apart, sketches, sets, plan), "links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            earlier, roots = roots, components.roots(links)
            if hasattr(earlier, "scratch_path"):
                common.discard(earlier)
        left = active.where("node <> pivot").select("bucket", "node", "weight")
    return roots


def _blocks(active: DataFrame, sketches: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of one bucket and two components whose sketches pass, found block against block."""
    count = F.ceil(F.col("present") / BLOCK).cast("int")
    rows = active.join(sketches, "node").withColumn("blocks", count).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root", "sketch", "size")

    def compare(found: pd.DataFrame) -> pd.DataFrame:
        low, high = found["low"].iloc[0], found["high"].iloc[0]
        left, right = (found[found["own"] == b] for b in (low, high))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        a, b = (np.array(x["sketch"].tolist(), np.int64).view(np.uint64) for x in (left, right))
        samples, whole = np.zeros((len(left), len(right)), np.int64), np.zeros((len(left), len(right)), np.int64)
        for i in range(SKETCH_WORDS + WHOLE_WORDS):
            (samples if i < SKETCH_WORDS else whole)[:] += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
        different = (100 - plan.percent) * (left["size"].to_numpy()[:, None] + right["size"].to_numpy()[None, :])
        near = (samples <= plan.most_bits) & ((100 + plan.percent) * whole <= different) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :])
        i, j = np.nonzero(near)
        x, y = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.groupBy("bucket", "low", "high").applyInPandas(compare, "a long, b long").where("a <> b")


def keep_one(documents: DataFrame, similarity_percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The documents, columns unchanged, of which one of each near-duplicate group stays: the one with
    the smallest doc_id. Rows without doc_id stay."""
    (gone,) = common.spare_names(documents, "gone")
    keys = link(documents.select("doc_id", "text"), similarity_percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(keys, documents["doc_id"].cast("long") == keys[gone], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"), 85)


#: Brute force: all pairs that share a shingle, counted on the shingles themselves.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM worded
), items AS (SELECT doc_id, md5_number(unnest(s)) AS x FROM sets),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT r.a AS doc_id, any_value(n) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r JOIN sizes ON sizes.doc_id = r.a GROUP BY r.a
"""
