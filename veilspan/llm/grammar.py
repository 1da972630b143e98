"""Token ids in grammar-compressed shard files (Re-Pair), with random access to single documents.

Documents are ranged by doc_id and cut into shards. In each shard the most frequent pairs of neighbouring
symbols are replaced by new symbols, over and over until no pair has LEAST_USES uses left. Pairs are
counted exactly. A round replaces many pairs at once, not one: where uses of two frequent pairs overlap
the more frequent pair has them, and what it leaves of the other is counted again in the next round. No pair
crosses a document's end, so that a document's symbols can be expanded by themselves.

A shard's payload is, little-endian: the magic bytes, then unsigned 32-bit counts (first rule symbol,
rules, documents, symbols); the rules' left and right symbols and their expansion lengths (unsigned
32-bit); for each document its presence byte (0: null doc_id), its doc_id (signed 64-bit), its first
symbol and its first token in the shard (unsigned 32-bit); then the symbols, three bytes each.
Payloads are stored by Spark, one row for each shard, in Parquet files in the shared folder: that folder
can be in a store that only Spark's writers reach, and a lost task's file is then replaced as a whole.

Cases: a null or empty text is the end id alone. Repeated rows are stored once for each row. A null
doc_id sorts first. An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm import common, tokens

MAGIC = b"GRM1"
END_ID = 2
#: Tokens after which a shard is closed (a longer document has a shard of its own), least uses of a rule,
#: bits of the hash whose counts keep rare pairs out of the exact count.
SHARD_TOKENS, LEAST_USES, COUNT_BITS = 1 << 20, 16, 19
NONE = np.iinfo(np.int32).max
LEFT, RIGHT, MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
SHARDS_SCHEMA = "part int, nth int, before long, n_docs int, n_tokens long, payload binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def compress(ids: np.ndarray, last: np.ndarray, least_uses: int = LEAST_USES) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """First rule symbol, rules (left, right), symbols, and which symbols are their document's last.

    Symbols are a linked list over the ids' places. `active` are the places whose pair may still have
    `least_uses` uses: at first all, later those that were frequent and those next to a new symbol. Other
    pairs only get rarer, so all uses of a frequent pair are active and its count is exact."""
    n = len(ids)
    first = int(ids.max()) + 1 if n else 0
    symbols = ids.astype(np.uint32)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[:-1][last] = n  # no pair crosses a document's end; n stands for none
    before[1:][last] = n
    before[0] = n
    alive, mark = np.ones(n, bool), np.zeros(n + 1, bool)
    rank_at = np.full(n + 1, NONE, np.int32)
    rules: list[np.ndarray] = []
    made = first
    active = np.flatnonzero(after[:-1] < n)
    while len(active):
        left, right = symbols[active], symbols[after[active]]
        bucket = _bucket(left, right)
        often = np.bincount(bucket, minlength=1 << COUNT_BITS)[bucket] >= least_uses  # fewer in its bucket: fewer of the pair
        active, left, right = active[often], left[often], right[often]
        pair = left.astype(np.uint64) << np.uint64(32) | right
        ordered = np.sort(pair)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        found = ordered[edge[np.diff(np.append(edge, len(ordered))) >= least_uses]]
        if not len(found):
            break
        rule = _places(found, pair, bucket[often])
        own = found[rule] == pair
        active, rule, twin = active[own], rule[own], left[own] == right[own]
        free = _free(active, twin, after, rank_at) if twin.any() else np.ones(len(active), bool)
        uses = np.bincount(rule[free], minlength=len(found))
        own = uses[rule] >= least_uses
        active, rule, free = active[own], rule[own], free[own]
        order = np.lexsort((found, -uses))
        rank = np.empty(len(found), np.int32)
        rank[order] = np.arange(len(found))
        # a place is replaced where its pair ranks before those that overlap it; others wait for the next round
        at, rule = active[free], rule[free]
        rank_at[at] = rank[rule]
        wins = (rank[rule] < rank_at[after[at]]) & (rank[rule] < rank_at[before[at]])
        rank_at[at] = NONE
        at, rule = at[wins], rule[wins]
        taken = np.bincount(rule, minlength=len(found)) >= least_uses
        if not taken.any():  # the first in rank always wins all its places
            break
        at, rule = at[taken[rule]], rule[taken[rule]]
        new = found[taken]
        rules.append(np.stack((new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)), axis=1))
        symbols[at] = (made + np.cumsum(taken) - 1)[rule]
        made += len(new)
        gone = after[at]
        beyond = after[gone]
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        alive[gone] = False
        last[at] |= last[gone]
        mark[active] = mark[at] = True
        mark[before[at]] = True
        mark[gone] = mark[n] = False
        active = np.flatnonzero(mark)
        mark[active] = False
        active = active[after[active] < n]
    return first, np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32), symbols[alive], last[alive]


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * LEFT ^ right * RIGHT) * MIX >> np.uint32(32 - COUNT_BITS)


def _places(found: np.ndarray, pair: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Where each pair is in the sorted `found`, if it is there. Most are looked up by their bucket; only
    those whose bucket has another pair are searched for."""
    table = np.full(1 << COUNT_BITS, -1, np.int32)
    table[_bucket((found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32))] = np.arange(len(found), dtype=np.int32)
    rule = table[bucket]
    other = np.flatnonzero((rule >= 0) & (found[rule] != pair))
    rule[other] = np.minimum(np.searchsorted(found, pair[other]), len(found) - 1)
    rule[rule < 0] = 0
    return rule


def _free(at: np.ndarray, twin: np.ndarray, after: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Which places of pairs are uses: in a run of one symbol only every second place is."""
    own = np.flatnonzero(twin)
    places = at[own]
    scratch[places] = np.arange(len(places))
    following = scratch[after[places]]  # the twin place that follows, as an index
    scratch[places] = NONE
    starts = np.ones(len(places), bool)
    starts[following[following != NONE]] = False
    free = np.ones(len(at), bool)
    step, odd = np.flatnonzero(starts), False
    while len(step):  # all runs at once, a place a step
        if odd:
            free[own[step]] = False
        step = following[step]
        step, odd = step[step != NONE], not odd
    return free


def expansion_lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """Tokens that each rule's symbol stands for; a rule's parts are older than the rule."""
    out: list[int] = []
    for left, right in rules.tolist():
        out.append((1 if left < first else out[left - first]) + (1 if right < first else out[right - first]))
    return np.array(out, np.uint32)


def pack_shard(doc_ids: list[int | None], encoded: list[bytes], least_uses: int = LEAST_USES) -> bytes:
    """The payload of a shard of documents, each given by its ids' bytes (one id at least)."""
    lengths = np.array([len(x) // 4 for x in encoded], np.int64)
    ids = np.frombuffer(b"".join(encoded), "<u4")
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    first, rules, symbols, last = compress(ids, last, least_uses)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    parts = [MAGIC, struct.pack("<4I", first, len(rules), len(doc_ids), len(symbols))]
    parts += [x.astype("<u4").tobytes() for x in (rules[:, 0], rules[:, 1], expansion_lengths(first, rules))]
    parts += [bytes(d is not None for d in doc_ids), np.array([d or 0 for d in doc_ids], "<i8").tobytes()]
    parts += [at.astype("<u4").tobytes(), starts.astype("<u4").tobytes()]
    parts.append(np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes())
    return b"".join(parts)


class Shard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard payload")
        self.first, rules, docs, n = struct.unpack_from("<4I", payload, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, count, at)
            at += found.nbytes
            return found

        self.left, self.right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        present, ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [int(d) if p else None for p, d in zip(present, ids, strict=True)]
        self.at, self.starts = take("<u4", docs), take("<u4", docs)
        packed = take("u1", 3 * n).reshape(-1, 3)
        self.symbols = packed[:, 0].astype(np.uint32) | packed[:, 1].astype(np.uint32) << np.uint32(8) | packed[:, 2].astype(np.uint32) << np.uint32(16)
        self.length_of = np.concatenate((np.ones(self.first, np.int64), self.lengths))

    def all_ids(self) -> np.ndarray:
        """The ids of all documents, through a pool of every rule's expansion."""
        place_of = np.cumsum(self.length_of) - self.length_of
        pool = np.arange(int(self.length_of.sum()), dtype=np.uint32)  # a plain symbol stands for itself
        place, length = place_of.tolist(), self.length_of.tolist()
        for i, parts in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.first):
            at = place[i]
            for part in parts:
                pool[at : at + length[part]] = pool[place[part] : place[part] + length[part]]
                at += length[part]
        lengths = self.length_of[self.symbols]
        ends = np.cumsum(lengths)
        return pool[np.repeat(place_of[self.symbols] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, rule by rule."""
        while (ruled := symbols >= self.first).any():
            at = np.cumsum(1 + ruled) - 1  # where each symbol's last part goes
            out = np.empty(int(at[-1]) + 1, np.uint32)
            out[at[~ruled]] = symbols[~ruled]
            out[at[ruled] - 1], out[at[ruled]] = self.left[symbols[ruled] - self.first], self.right[symbols[ruled] - self.first]
            symbols = out
        return symbols

    def document(self, i: int, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids `start` to `start + count` of the i-th document. Only symbols that reach into that range are
        expanded; the stored expansion lengths tell which."""
        symbols = self.symbols[self.at[i] : self.at[i + 1] if i + 1 < len(self.at) else len(self.symbols)]
        ends = np.cumsum(self.length_of[symbols])
        stop = int(ends[-1]) if count is None else min(start + count, int(ends[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[low - 1]) if low else 0
        return self.expand(symbols[low:high])[start - skipped : stop - skipped]


def encode_shards(documents: DataFrame, *, end_id: int = END_ID, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shards of the documents in ascending doc_id order: part and nth order them, `before` is the
    number of tokens before a shard in its part."""
    path = path or vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        encoded: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            row = [part, nth, before, len(doc_ids), held, pack_shard(doc_ids, encoded)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "nth", "before", "n_docs", "n_tokens", "payload"])

        encode_all = tokens.encoder(path, tokens.DROPPED).encode_all
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist()), strict=True):
                data += end
                if held and held + len(data) // 4 > shard_tokens:
                    yield close()
                    nth, before, doc_ids, encoded, held = nth + 1, before + held, [], [], 0
                doc_ids.append(doc)
                encoded.append(data)
                held += len(data) // 4
        if held:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return ordered.select("doc_id", "text").mapInArrow(encode, SHARDS_SCHEMA)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards' payloads.

    What comes before a part is summed over the parts' totals: a row for each part, as many as the
    writing job had tasks, is all that is broadcast."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(payload)
                ids = np.ascontiguousarray(shard.all_ids().astype("<u4"))
                ends = np.append(shard.starts[1:], len(ids)).astype(np.int64)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(shard.starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts.astype(np.int64) + start), pa.array(ends - shard.starts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = common.materialize(encode_shards(common.table(spark, sf_dir, "documents")), "token-shards")
    return read_shards(shards)
