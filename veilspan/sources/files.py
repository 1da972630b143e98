"""Files as tables of text units."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

from veilspan import session

KINDS = {"txt": "text", "md": "text", "log": "text", "json": "text", "csv": "csv", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image"}
CONTENT_TYPES = {"text/plain": "text", "application/json": "text", "text/csv": "csv", "application/pdf": "pdf", "image/png": "image", "image/jpeg": "image"}
MOST_PART_BYTES = 64 << 20


def kind(name: Column, content_type: Column) -> Column:
    """A file's kind: by its content type, else by its extension, else `unsupported`."""
    by_type = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    by_end = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(by_type[content_type], by_end[F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))], F.lit("unsupported"))


def _ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a CSV reader is inside a quoted cell after a line that it began inside one, or not."""
    if '"' not in line:
        return quoted
    at, fresh = 0, not quoted
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            quoted, at = False, at + 1
        elif fresh and line.startswith('"', at):
            quoted, fresh, at = True, False, at + 1
            continue
        fresh = False
        at = line.find(",", at)  # a quote within a cell that none began is a character
        if at < 0:
            return False
        fresh, at = True, at + 1


_LINES = "file string, block long, i long, line string, apart long, within long, quoted_after boolean, open_after boolean"


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line how many records have begun in its block up to it, if the block began outside of a quoted cell (`apart`) or
    inside one (`within`, less one), null where the line goes on with a record; and the two states after it."""
    now, i, counts, states = None, 0, [0, 0], [False, True]
    for batch in batches:
        out = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            file, block, line = key
            if (file, block) != now:
                now, i, counts, states = (file, block), 0, [0, 0], [False, True]
            begins = [not q for q in states]
            counts = [n + b for n, b in zip(counts, begins, strict=True)]
            states = [_ends_quoted(line, q) for q in states]
            out.append((file, block, i, line, *counts, *states))
            i += 1
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        names = [c.split()[0] for c in _LINES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=names)


_BEGUN = pa.list_(pa.struct([("block", pa.int64()), ("quoted", pa.bool_()), ("records", pa.int64())]))


@F.arrow_udf(from_arrow_type(_BEGUN))
def _begun(files: pa.Array) -> pa.Array:
    """For each block of a file whether it begins inside a quoted cell, and the records that began before it."""
    out = []
    for blocks in files.to_pylist():
        quoted, records, own = False, 0, []
        for b in blocks:
            own.append({"block": b["block"], "quoted": quoted, "records": records})
            records += b["end"]["within" if quoted else "apart"]
            quoted = b["end"]["open_after" if quoted else "quoted_after"]
        out.append(own)
    return pa.array(out, _BEGUN)


def csv_records(lines: DataFrame) -> DataFrame:
    """file, record (from 0), text of the CSV records of lines (file, block, line, in their order within a block): a quoted cell may
    hold line ends, and a record may go on in the next block of its file.

    A block is read without knowing whether it began inside a quoted cell: both cases are carried along. How each block ends in
    either case is then composed along a file's blocks, and every line knows its record. Line ends in cells are given as \\n."""
    session.ship_package(lines.sparkSession)
    read = lines.select("file", "block", "line").mapInArrow(_read_lines, _LINES)
    last = read.groupBy("file", "block").agg(F.max_by(F.struct("apart", "within", "quoted_after", "open_after"), "i").alias("end"))
    blocks = last.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "end"))).alias("blocks"))  # one entry a block
    begun = blocks.select("file", F.inline(_begun("blocks")))
    placed = read.join(begun, ["file", "block"])
    number = F.col("records") + F.when(F.col("quoted"), F.col("within")).otherwise(F.col("apart")) - 1
    parts = placed.withColumn("record", number).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "i", "line"))).alias("parts"))
    return parts.select("file", "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))


def read_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line of text files as Spark splits them."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def csv_units(records: DataFrame, *, gateway: bool = False) -> DataFrame:
    """file, location, text of CSV records (as of `csv_records`): cells as they stand, joined by tabs, rows that are blank
    left out, at `row[i]` counted from 0. The `gateway` form joins by spaces, leaves out rows whose cells are all empty (a
    blank is none), and counts `row n` from 1."""
    session.ship_package(records.sparkSession)

    @F.arrow_udf(StringType())
    def joined(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            cells = next(csv.reader(io.StringIO(text or "", newline="")), [])
            kept = any(cells) if gateway else "".join(cells).strip()
            out.append((" " if gateway else "\t").join(cells) if kept else None)
        return pa.array(out, pa.string())

    place = F.concat(F.lit("row "), (F.col("record") + 1).cast("string")) if gateway else F.concat(F.lit("row["), F.col("record").cast("string"), F.lit("]"))
    return records.select("file", place.alias("location"), joined("text").alias("text")).where("text is not null")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each text file as one unit."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit("document").alias("location"), F.col("value").alias("text"))


def _paragraphs(data: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if archive.getinfo("word/document.xml").file_size > MOST_PART_BYTES:
            raise ValueError("document part too large")
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    for i, p in enumerate(e for e in root.iter() if e.tag.endswith("}p")):
        if words := "".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")).strip():
            yield f"paragraph[{i}]", words


def _sheet_rows(data: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")))
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for i, row in enumerate(e for e in ElementTree.fromstring(archive.read(sheet)).iter() if e.tag.endswith("}row")):
                cells = []
                for cell in row:
                    value = next((e.text or "" for e in cell.iter() if e.tag.endswith(("}v", "}t"))), "")
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                if any(cells):
                    yield f"{sheet.rsplit('/', 1)[1][:-4]}!row[{i}]", "\t".join(cells)


def office_units(files: DataFrame) -> DataFrame:
    """file, location, text, error of docx and xlsx files given as path and content (binaryFile). A file
    that cannot be read gives one row with its error; PDF and images have no reader here."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                reader = {"docx": _paragraphs, "xlsx": _sheet_rows}.get(path.rsplit(".", 1)[-1].lower())
                try:
                    if reader is None:
                        raise ValueError("no reader for this kind of file")
                    out += [(path, where, text, None) for where, text in reader(bytes(content))]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    out.append((path, None, None, str(error)))
            yield pd.DataFrame(out, columns=["file", "location", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "file string, location string, text string, error string")
