"""Text normalization and sentences as column expressions."""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veilspan import session
from veilspan.functions import fixed

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def drop_zero_width(text: Column) -> Column:
    return F.translate(text, fixed.ZERO_WIDTH, "")


def fold_width(text: Column) -> Column:
    """Full-width forms as their ASCII characters, one for one."""
    return F.translate(text, _WIDE, _NARROW)


def fold_arabic_digits(text: Column) -> Column:
    return F.translate(text, fixed.ARABIC_INDIC_DIGITS + fixed.EASTERN_ARABIC_DIGITS, "0123456789" * 2)


def join_spaced(text: Column) -> Column:
    """Runs of four or more single characters parted by single spaces, joined."""
    gaps, runs = F.split(text, fixed.SPACED_RUN, -1), F.regexp_extract_all(text, F.lit(fixed.SPACED_RUN), F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), runs.alias("run"))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(F.translate(p["run"], " ", ""), F.lit("")))), "")


def normalize(text: Column) -> Column:
    """The text that detectors read, without its offsets."""
    return normalized(text)["text"]


def folded_with_places(text: str) -> tuple[str, list[int]]:
    """A text without zero-width characters, with characters folded (NFKC, where one gives one) and with
    spaced runs joined; and the place in the original of each character that is left."""
    fold = {c: f if len(f := unicodedata.normalize("NFKC", c)) == 1 else c for c in set(text)}
    places = [i for i, c in enumerate(text) if c not in fixed.ZERO_WIDTH]
    folded = "".join(fold[text[i]] for i in places)
    gone: set[int] = set()
    for run in _SPACED.finditer(folded):
        gone.update(range(run.start() + 1, run.end(), 2))
    if gone:
        places = [p for j, p in enumerate(places) if j not in gone]
        folded = "".join(c for j, c in enumerate(folded) if j not in gone)
    return folded, places


_SPACED = re.compile(fixed.SPACED_RUN)
#: What any spaced run holds.
_SPACED_HINT = re.compile(r" \S \S ")


@functools.cache
def _kept(character: str) -> bool:
    """Is a character its own normal form?"""
    folded = unicodedata.normalize("NFKC", character)
    return character not in fixed.ZERO_WIDTH and (folded == character or len(folded) != 1)


def normal_form(text: str) -> tuple[str, list[int] | None]:
    """As `folded_with_places`, with None for the places of a text that is its own normal form."""
    spaced = _SPACED_HINT.search(text) and _SPACED.search(text)
    return (text, None) if not spaced and (text.isascii() or all(map(_kept, set(text)))) else folded_with_places(text)


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("places", ArrayType(IntegerType()))]))
def _folded(texts: pa.Array) -> pa.Array:
    found = [(None, None) if t is None else folded_with_places(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.int32()))], names=["text", "places"], mask=texts.is_null())


def normalized(text: Column) -> Column:
    """struct(text, places): the text that detectors read, and where its characters stand in the original;
    places are null where the text is its own normal form. Only texts that may change leave the JVM."""
    session.ship_package(SparkSession.active())
    changes = text.rlike(r"[^\x00-\x7F]") | text.rlike(fixed.SPACED_RUN)
    return F.coalesce(_folded(F.when(changes, text)), F.struct(text.alias("text"), F.lit(None).cast("array<int>").alias("places")))


def offset_map(text: Column) -> Column:
    """For each character of the normalized text, its place in the original."""
    whole = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.coalesce(normalized(text)["places"], whole)


@functools.cache
def _sentences(jvm: int):
    session.ship_package(SparkSession.active())

    @F.arrow_udf("array<struct<start:int,end:int,sentence:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        from veilspan.operators.sweep import sentences_in

        rows = [None if t is None else [{"start": a, "end": b, "sentence": t[a:b]} for a, b in sentences_in(t)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string())])))

    return cut


def sentence_array(text: Column) -> Column:
    """array<struct<start,end,sentence>> of the sentences that are not blank; following white space belongs to them."""
    return _sentences(id(SparkSession.active()._jvm))(text)


def sentences(units: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """idx, start, end, sentence for each sentence that is not blank."""
    rows = units.where(F.col(text).isNotNull()).select(*keep, F.posexplode(sentence_array(F.col(text))).alias("idx", "s"))
    return rows.select(*keep, "idx", "s.start", "s.end", "s.sentence")
