"""Interval operators on span tables: overlap joins, gap merge, resolution, precedence, rewriting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType

from veilspan import session
from veilspan.operators import sweep


#: Characters of a bin of a unit.
BIN = 1024


def _in_bins(spans: DataFrame) -> DataFrame:
    """Each span once for every bin of its unit that it lies in."""
    first, last = F.floor(F.col("start") / BIN), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / BIN)
    return spans.withColumn("bin_", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of one unit that overlap; right columns get the prefix `r_`. Spans are dealt to bins of BIN
    characters, so a unit with very many spans is many bins and none of its spans meets one that lies elsewhere; a pair
    is given in the bin where the later of both starts."""
    other = _in_bins(right).select(F.col(key), "bin_", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    met = _in_bins(left).join(other, [key, "bin_"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    once = met.where(F.col("bin_") == F.floor(F.greatest("start", "r_start") / BIN))
    return once.select(*left.columns, *[f"r_{c}" for c in right.columns if c != key])


def without_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Spans of `left` that no span of `right` overlaps. A null key or place overlaps nothing."""
    places = left.select(key, "start", "end").where(F.col(key).isNotNull()).distinct()
    hit = overlapping(places, right.select(key, "start", "end").distinct(), key).select(*[F.col(c).alias(f"hit_{c}") for c in (key, "start", "end")]).distinct()
    return left.join(hit, [F.col(c) == F.col(f"hit_{c}") for c in (key, "start", "end")], "left_anti")


def locked_first(locked: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """Locked spans, and the detected spans that none of them overlaps."""
    return without_overlap(detected, locked, key).unionByName(locked)


def merge_gaps(spans: DataFrame, key: str, text: str) -> DataFrame:
    """Neighbouring spans of one label with one to three blanks or commas between them, merged: islands
    over each unit's spans. The island keeps its first span's columns and its greatest confidence."""
    w = Window.partitionBy(key).orderBy("start", F.desc(F.col("end") - F.col("start")), "ord")
    gap = F.substring(F.col(text), F.col("p_end") + 1, F.col("start") - F.col("p_end"))
    joins = (F.col("label") == F.col("p_label")) & (F.col("start") >= F.col("p_end")) & gap.rlike(r"^[\s,]{1,3}$")
    marked = spans.withColumn("p_end", F.lag("end").over(w)).withColumn("p_label", F.lag("label").over(w)).withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("start", F.col("start") - F.col("end"), "ord")
    return islands.groupBy(key, "island").agg(
        F.min("start").alias("start"), F.max_by("end", place).alias("end"), F.first("label").alias("label"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("parts"),
    ).drop("island")


_FIELDS = ("start", "end", "label", "confidence", "format", "source")
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64()), ("format", pa.string()), ("source", pa.string()), ("how", pa.string())]))


def _tuples(spans: list[dict], fields: tuple[str, ...] = _FIELDS) -> list[tuple]:
    return [tuple(s[f] for f in fields) for s in spans]


def _dicts(spans: list[tuple]) -> list[dict]:
    return [dict(zip((*_FIELDS, "how"), s, strict=True)) for s in spans]


@F.arrow_udf(from_arrow_type(_TYPE))
def _resolve(spans: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _dicts(sweep.resolved(_tuples(x))) for x in spans.to_pylist()], _TYPE)


@F.arrow_udf(from_arrow_type(_TYPE))
def _repaired(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
    return pa.array([[] if t is None or x is None else _dicts(sweep.repaired(t, _tuples(x))) for t, x in rows], _TYPE)


@F.arrow_udf(StringType())
def _splice(texts: pa.Array, edits: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), edits.to_pylist(), strict=True)
    return pa.array([None if t is None or e is None else sweep.spliced(t, _tuples(e, ("start", "end", "new"))) if e else t for t, e in rows], pa.string())


@F.arrow_udf(ArrayType(IntegerType()))
def _locked(spans: pa.Array) -> pa.Array:
    """Numbers of the spans that stay."""
    rows = [None if x is None else [(s["start"], s["end"], i, s["confidence"]) for i, s in enumerate(x)] for x in spans.to_pylist()]
    return pa.array([None if r is None else [s[2] for s in sweep.locked_resolved(r)] for r in rows], pa.list_(pa.int32()))


def _shipped() -> None:
    session.ship_package(SparkSession.active())


def resolve(spans: Column) -> Column:
    """Overlaps of an array of spans (start, end, label, confidence, format, source; sorted by start) resolved in one
    pass: equal labels unite, a significant overlap (over 0.4 of the shorter) keeps the higher score,
    a slight one trims the later span."""
    _shipped()
    return _resolve(spans)


def repaired(text: Column, spans: Column) -> Column:
    """An array of a text's spans (start, end, label, confidence, format, source) with ends repaired, gaps merged and
    overlaps resolved, in the row where the text is. Spans of one place keep their order."""
    _shipped()
    return _repaired(text, spans)


def repair(spans: DataFrame, key: str, text: str) -> DataFrame:
    """Spans (key, text column, ord, start, end, label, confidence) repaired: a unit's spans are gathered beside
    one copy of its text."""
    listed = spans.groupBy(key).agg(F.first(text).alias(text), F.array_sort(F.collect_list(F.struct("ord", "start", "end", "label", "confidence", F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("source")))).alias("spans"))
    return listed.select(key, F.explode(repaired(F.col(text), F.col("spans"))).alias("s")).select(key, *[f"s.{c}" for c in ("start", "end", "label", "confidence", "how")])


def locked_resolved(locked: Column) -> Column:
    """Locked spans (structs that begin with start, end) in order of their start; the first accepted span that a later one
    overlaps is replaced by it only if its confidence is greater."""
    _shipped()
    ordered = F.array_sort(locked)
    return F.transform(_locked(F.transform(ordered, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "confidence")]))), lambda i: F.get(ordered, i))


def splice(text: Column, edits: Column) -> Column:
    """The text with an array of edits (start, end, new) applied from left to right; an edit that starts
    before the last one's end is skipped."""
    _shipped()
    return _splice(text, edits)


def context_ranges(sentences: DataFrame, actioned: DataFrame, key: str) -> DataFrame:
    """Sentences next to one that an actioned span starts in, but hold none themselves."""
    hit = sentences.join(actioned.select(F.col(key), F.col("start").alias("s_start")), key).where((F.col("s_start") >= F.col("start")) & (F.col("s_start") < F.col("end"))).select(key, "idx").distinct()
    marked = sentences.join(hit.withColumn("hit", F.lit(1)), [key, "idx"], "left")
    w = Window.partitionBy(key).orderBy("idx")
    return marked.withColumn("near", F.coalesce(F.lag("hit").over(w), F.lead("hit").over(w))).where("hit is null and near = 1").drop("hit", "near")
