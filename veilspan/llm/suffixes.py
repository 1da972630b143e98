"""Removal of repeated byte strings: prefix doubling on sampled suffixes.

A byte is removed when some string of LENGTH bytes that covers it also starts elsewhere in the table.
Suffixes are ranked by fingerprints of growing prefixes, and those whose rank is unique drop out:

1. Only suffixes at anchors enter. An anchor is the place of the least fingerprint of a GRAM-byte
   string in some window of LENGTH bytes, so equal windows have an anchor at the same place in them,
   and one suffix in about seventy represents them all. Spark ranks the anchors' first GRAM bytes;
   anchors with a unique rank end here.
2. Ranks double: (rank at p, rank at p + GRAM) ranks the 2 * GRAM bytes from an anchor on, and (rank at
   p - GRAM, rank at p) those that end with its GRAM bytes. Any window around an anchor holds one of the two
   strings whole, so an anchor with two unique ranks ends here, and where one is unique the windows that hold it
   are not looked at again.
3. Anchors are ranked by all that a window around them can hold: up to LENGTH - GRAM bytes
   before and LENGTH from the anchor on. An anchor whose rank is shared settles every window around it at once.
4. Of the other anchors, the windows left by step 2 are ranked one by one at LENGTH bytes: the
   surroundings of each distinct class of an anchor rank are sent to where that rank is sorted, and
   their windows' fingerprints are ranked there. Ranks with more than CROWD classes are not gathered;
   their windows' fingerprints are counted by Spark instead, with sums before the shuffle.

All repeated windows of an anchor hold the anchor's string, so together they are one interval, known by
the first and last of them. Every rank is compared within its anchor's rank, so two 64-bit fingerprints, of the
anchor's bytes and of the longer string, have to agree before bytes are removed. Bitmaps of fixed size keep rows that cannot
matter out of two shuffles; they hold hashed keys, may pass rows they need not, and an exact join
follows. Texts are worked on in pieces of PIECE bytes that overlap by what an anchor can reach.

Cases: a null or empty text is empty and loses nothing; a text under LENGTH bytes neither. Repeated
rows are separate texts, so a repeated row of LENGTH bytes or more is removed whole in every copy.
A null doc_id is treated as any other key. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common
from veilspan.llm.bitmaps import bitmap, in_bitmap, maybe
from veilspan.llm.fingerprints import Prints, anchors, stir

LENGTH, GRAM = 200, 64
AROUND = LENGTH - GRAM
CROWD = 1024
#: Bytes of a text that are worked on at once.
PIECE = 1 << 18


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bytes(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def _text_rows(documents: DataFrame) -> DataFrame:
    """doc_id, text, row (hash of both): equal rows share a row key."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))


def _pieces(data: bytes) -> Iterator[tuple[int, Prints, np.ndarray, np.ndarray]]:
    """Of each piece of a text: the place of its first byte, its fingerprints, those of its GRAM-byte strings, and
    the anchors (places in the piece). Each anchor is in one piece, with all that its windows can hold."""
    for start in range(0, max(len(data) - LENGTH + 1, 0) + AROUND, PIECE):
        low = max(0, start - AROUND)
        if len(data) - low < LENGTH:
            break
        prints = Prints(data[low : start + PIECE + LENGTH])
        grams = prints.all_of(GRAM)
        at, _ = anchors(grams, AROUND + 1)
        yield low, prints, grams, at[(at + low >= start) & (at + low < start + PIECE)]


def _anchor_ranks(rows: DataFrame) -> DataFrame:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams[at] for data in _bytes(batch.column(0)) for _, _, grams, at in _pieces(data)]
            yield _batch({"gram": _signed(np.concatenate(found) if found else np.zeros(0, np.uint64))})

    return rows.select("text").mapInArrow(rank, "gram long")


def _shared_anchors(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """row, at, before, after, gram, earlier and later (the strings of GRAM bytes that end and begin where
    the gram does; null where the text has none), whole of anchors whose gram may be shared."""
    names = ("row", "at", "before", "after", "gram", "whole", "earlier", "later")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for row, data in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                for low, prints, grams, at in _pieces(data):
                    at = at[in_bitmap(bits, grams[at])]
                    before, after = np.minimum(at, AROUND), np.minimum(len(data) - low - at, LENGTH)
                    whole = stir(prints.of(at - before, before + after) + before.astype(np.uint64))
                    beside = [np.where(has, grams[np.where(has, at + by, 0)], np.uint64(0)) for by, has in ((-GRAM, before >= GRAM), (GRAM, after >= 2 * GRAM))]
                    out.append((np.full(len(at), row, np.int64), at + low, before, after, *(x.view(np.int64) for x in (grams[at], whole, *beside))))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 8
            kinds = (pa.int64(), pa.int32(), pa.int16(), pa.int16(), *[pa.int64()] * 4)
            lacking = dict(earlier=columns[2] < GRAM, later=columns[3] < 2 * GRAM)
            yield _batch({n: pa.array(c, k, mask=lacking.get(n), safe=False) for n, c, k in zip(names, columns, kinds, strict=True)})

    return rows.select("row", "text").mapInArrow(rank, "row long, at int, before short, after short, gram long, whole long, earlier long, later long")


def _doubled(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes with is_earlier and is_later: whether the 2 * GRAM bytes that end, or begin, with the
    anchor's are shared. Those with neither are left out."""
    of_class = classes.withColumn("earlier", F.col("one.earlier")).withColumn("later", F.col("one.later"))
    for side in ("earlier", "later"):
        shared = found.where(F.col(side).isNotNull()).groupBy("gram", side).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", side, F.lit(True).alias(f"is_{side}"))
        of_class = of_class.join(shared, ["gram", side], "left").withColumn(f"is_{side}", F.coalesce(f"is_{side}", F.lit(False)))
    return of_class.where("is_earlier or is_later").drop("earlier", "later")


def _surroundings(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, classes, single, row, first (place of the first byte), low and high (the first and last
    window looked at), data of the wanted anchors."""
    low = F.when(F.col("is_earlier"), 0).otherwise(F.greatest(F.lit(0), F.col("before") - GRAM + 1))
    high = F.when(F.col("is_later"), F.col("before")).otherwise(F.col("before") - (LENGTH - 2 * GRAM) - 1)
    ranged = wanted.withColumn("low", low.cast("int")).withColumn("high", high.cast("int"))
    per_row = ranged.groupBy("row").agg(F.collect_list(F.struct("at", "before", "after", "gram", "single", "classes", "low", "high")).alias("places"))  # of one text
    bits = bitmap(per_row, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, data, places in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in places:
                    first = p["at"] - p["before"]
                    out.append((p["gram"], p["classes"], p["single"], row, first, p["low"], p["high"], data[first : p["at"] + p["after"]]))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary())
            yield _batch({n: pa.array(c, k) for n, c, k in zip(("gram", "classes", "single", "row", "first", "low", "high", "data"), columns, kinds, strict=True)})

    texts = rows.where(maybe(bits)("row"))
    joined = texts.join(per_row, "row").select("row", "text", "places")
    return joined.mapInArrow(cut, "gram long, classes long, single boolean, row long, first int, low short, high short, data binary")


class Windows:
    """The windows of some surroundings that hold their anchor's gram and are still looked at."""

    def __init__(self, batch: pa.Table | pa.RecordBatch):
        data = batch.column("data").to_pylist()
        self.row = batch.column("row").to_numpy()
        self.first = batch.column("first").to_numpy().astype(np.int64)
        self.single = batch.column("single").to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.array([len(d) for d in data], np.int64)
        low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
        counts = np.maximum(np.minimum(sizes - LENGTH, high) + 1 - low, 0)
        base = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(data)), counts)
        self.offset = np.arange(len(self.of)) - np.repeat(np.cumsum(counts) - counts - low, counts)
        self.gram = batch.column("gram").to_numpy()[self.of]
        prints = Prints(b"".join(data))
        self.prints = prints.of(base[self.of] + self.offset, LENGTH)
        self.start = self.first[self.of] + self.offset
        self.place = stir(self.row[self.of].view(np.uint64) + self.start.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _repeated_here(windows: Windows) -> np.ndarray:
    """Which windows' fingerprints occur at two places among these; a class of several anchors counts
    as two places."""
    order = np.lexsort((windows.place, windows.prints, windows.gram))
    prints, place, gram = windows.prints[order], windows.place[order], windows.gram[order]
    many = ~windows.single[windows.of[order]]
    new = np.concatenate(([True], (prints[1:] != prints[:-1]) | (gram[1:] != gram[:-1])))
    group = np.cumsum(new) - 1
    other = np.concatenate(([False], (place[1:] != place[:-1]) & ~new[1:]))
    again = np.bincount(group, other | many) > 0
    out = np.zeros(len(order), bool)
    out[order] = again[group]
    return out


def _intervals(windows: Windows, repeated: np.ndarray) -> pa.RecordBatch:
    """row, start, end covered by the repeated windows of each anchor that is the only one of its class."""
    at = np.flatnonzero(repeated & windows.single[windows.of])
    of = windows.of[at]
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    last = np.append(edge[1:], len(of))[: len(edge)] - 1
    return _batch({"row": pa.array(windows.row[of[edge]], pa.int64()), "start": pa.array(windows.start[at[edge]]), "end": pa.array(windows.start[at[last]] + LENGTH)})


def _compare_gathered(around: DataFrame) -> DataFrame:
    """row, start, end from ranks that are sorted together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            grams = table.column("gram").to_numpy()
            whole = int(np.searchsorted(grams, grams[-1]))  # the last rank may go on
            held = table.slice(whole)
            if whole:
                windows = Windows(table.slice(0, whole))
                yield _intervals(windows, _repeated_here(windows))
        if held is not None and held.num_rows:
            windows = Windows(held)
            yield _intervals(windows, _repeated_here(windows))

    return around.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, "row long, start long, end long")


def _compare_crowds(around: DataFrame) -> DataFrame:
    """row, start, end from ranks with too many classes to gather."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(batch)
            anchor = stir(w.row.view(np.uint64) + w.first.astype(np.uint64))[w.of]
            yield _batch({"gram": pa.array(w.gram), "print": _signed(w.prints), "place": _signed(w.place), "single": pa.array(w.single[w.of]), "row": pa.array(w.row[w.of]), "start": pa.array(w.start), "anchor": _signed(anchor)})

    windows = common.materialize(around.mapInArrow(spread, "gram long, print long, place long, single boolean, row long, start long, anchor long"), "crowd-windows")
    counted = windows.groupBy("gram", "print").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.bool_and("single").alias("single"))
    again = counted.where("low <> high or not single").select("gram", "print")
    found = windows.where("single").join(again, ["gram", "print"], "left_semi")
    return found.groupBy("row", "anchor").agg(F.min("start").alias("start"), (F.max("start") + LENGTH).alias("end")).select("row", "start", "end")


def covered(documents: DataFrame) -> DataFrame:
    """row, spans (start, end; unordered, may overlap) of the rows with removed bytes."""
    rows = _text_rows(documents)
    shared = common.materialize(_anchor_ranks(rows).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "shared-grams")
    found = common.materialize(_shared_anchors(rows, bitmap(shared, "gram")).join(shared, "gram", "left_semi"), "shared-anchors")
    classes = found.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "before", "after", "earlier", "later")).alias("one"))
    classes = common.materialize(classes, "anchor-classes")
    settled = found.join(classes.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").where(F.col("before") + F.col("after") >= LENGTH)
    spans = settled.select("row", (F.col("at") - F.col("before")).cast("long").alias("start"), (F.col("at") + F.col("after")).cast("long").alias("end"))
    open_ = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").select("gram", "classes")
    wanted = _doubled(found, classes).join(open_, "gram").select("gram", "classes", (F.col("n") == 1).alias("single"), "one.*", "is_earlier", "is_later").where(F.col("before") + F.col("after") >= LENGTH)
    around = common.materialize(_surroundings(rows, common.materialize(wanted, "open-anchors")), "surroundings")
    spans = spans.unionByName(_compare_gathered(around.where(F.col("classes") <= CROWD)))
    if not (crowds := around.where(F.col("classes") > CROWD)).isEmpty():
        spans = spans.unionByName(_compare_crowds(crowds))
    return common.materialize(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "covered")  # of one text


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = _text_rows(documents)
    found = covered(documents)
    has_spans = maybe(bitmap(found, "row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, data, spans in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, removed, runs, end = hashlib.sha256(), 0, 0, 0
                at = -1
                for s in sorted(((s["start"], s["end"]) for s in spans or ())):
                    if s[0] > at:  # a new run
                        kept.update(data[end : s[0]])
                        runs += 1
                        removed += s[1] - s[0]
                        at = end = s[1]
                    elif s[1] > at:
                        removed += s[1] - at
                        at = end = s[1]
                kept.update(data[end:])
                out.append((doc, len(data), removed, runs, kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (*[pa.int64()] * 4, pa.string())
            yield _batch({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, kinds, strict=True)})

    touched = rows.where(has_spans("row")).join(found, "row", "left").select("doc_id", "text", "spans")
    clean = rows.where(~has_spans("row")).select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    return touched.unionByName(clean).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
