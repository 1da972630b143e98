"""Line deduplication by log templates of a fixed-depth parse tree.

A line's path in the tree is its token count and its first DEPTH tokens (a token that holds a digit
counts as `<*>`). In each leaf, a token stays part of the template at its position when it stands
there in LEAST_DOCUMENTS documents at least; other tokens are variable fields. A line follows a
template when at least SHARE_PERCENT of its tokens stay. Templates found in LEAST_DOCUMENTS documents are recurring:
all their lines are dropped but the first (smallest doc_id, then line number), so that one copy of any
content remains.

A first pass counts the lines of each leaf; a bitmap of the leaves with enough of them keeps all other
lines out of the rest. The second pass ships one row a line, its tokens as 64-bit hashes, to where its
leaf is sorted. Leaves of up to GATHER_LINES lines are parsed there, several at once, on arrays; larger
ones are counted by Spark token by token with sums before the shuffle, so that no leaf is gathered
whatever its size. Both ways give the same result.

That rule (`RULE`) is what op3's SQL defines. The pipeline's stage (`drop_recurring`) drops more, by
`WIDE_RULE`: tokens with a digit are fields that match any value; a token is
constant, besides by the count above, at each of the shares `shares` of its leaf's documents, so that
fields whose values become frequent in a large corpus remain fields; and a line that is not blank and
stands in EXACT_DOCUMENTS documents, outer blanks apart, recurs however few or many tokens it has. A
template needs one constant token.

Cases: a null text stays null with no lines; an empty text is one blank line. Blank lines are never
dropped, lines of fewer than LEAST_TOKENS tokens only by the stage and only as exact repeats. Repeated rows (same doc_id and text) count as one
document and are treated alike. A null doc_id sorts first, and so does one that is not a whole number.
Columns other than the text are untouched, whatever their names. Very long texts are parsed in pieces
of whole lines. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common
from veilspan.llm.bitmaps import bitmap, in_bitmap
from veilspan.llm.features import tokens_of
from veilspan.llm.fingerprints import Prints, stir

LEAST_TOKENS, LEAST_DOCUMENTS, SHARE_PERCENT = 3, 4, 60
EXACT_DOCUMENTS = 2
#: Lines of a leaf that are parsed in one task, and bytes of text parsed at once.
GATHER_LINES, PIECE = 4096, 1 << 18
BLANK = " \t\v\f\r"


@dataclass(frozen=True)
class Rule:
    """`shares`: percentages of a leaf's documents at which a token is constant, one template each (0: the
    count alone); `fields_match`: tokens with a digit count as matching; `exact`: exact lines recur too."""

    shares: tuple[int, ...] = (0,)
    fields_match: bool = False
    exact: bool = False


RULE = Rule()
WIDE_RULE = Rule((0, 5, 20, 50), True, True)

_ANY = tokens_of(np.frombuffer(b"<*>", np.uint8))[2][0]
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]


class Lines:
    """The lines of some whole-line text: their tokens as hashes and their leaves."""

    def __init__(self, data: bytes, exact: bool):
        codes = np.frombuffer(data, np.uint8)
        starts, ends, hashes = tokens_of(codes)
        breaks = np.flatnonzero(codes == 10)
        self.count = len(breaks) + 1
        line = np.searchsorted(breaks, starts)
        self.size = np.bincount(line, minlength=self.count)
        self.first = np.cumsum(self.size) - self.size
        digits = np.cumsum((codes >= 48) & (codes <= 57))
        self.field = digits[ends - 1] != digits[starts] if len(starts) else np.zeros(0, bool)
        if len(starts):
            self.field |= (codes[starts] >= 48) & (codes[starts] <= 57)
        self.fields = np.bincount(line[self.field], minlength=self.count)
        self.parsed = np.flatnonzero(self.size >= LEAST_TOKENS)
        path = np.where(self.field, _ANY, hashes)
        at = self.first[self.parsed]
        leaf = stir(stir(path[at] * _K[0] + self.size[self.parsed].astype(np.uint64)) + path[at + 1] * _K[1]) if len(at) else np.zeros(0, np.uint64)
        self.leaf = np.zeros(self.count, np.uint64)
        self.leaf[self.parsed] = leaf
        place = np.arange(len(starts), dtype=np.uint64) - self.first[line].astype(np.uint64)
        self.held = stir(stir(hashes + place * _K[2]) + self.leaf[line])
        self.solid = np.flatnonzero(self.size)
        if exact:
            last = self.first[self.solid] + self.size[self.solid] - 1
            begin = starts[self.first[self.solid]]
            self.whole = Prints(data).of(begin, ends[last] - begin)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of whole lines, of PIECE bytes at most where lines are not longer."""
    at = 0
    while len(data) - at > PIECE:
        end = data.rfind(b"\n", at, at + PIECE)
        end = data.find(b"\n", at + PIECE) if end < 0 else end
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:]


def _lines(batch: pa.RecordBatch, exact: bool) -> Iterator[tuple[Lines, np.ndarray, np.ndarray]]:
    """Lines of the batch's last column, with each line's row in the batch and number in its text."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def parse() -> tuple[Lines, np.ndarray, np.ndarray]:
        found = Lines(b"\n".join(data for data, _, _ in held), exact)
        counts = np.array([data.count(b"\n") + 1 for data, _, _ in held])
        number = np.arange(found.count) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat([first for _, _, first in held], counts)
        return found, np.repeat([i for _, i, _ in held], counts), number

    for i, data in enumerate(batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()):
        first = 0
        for piece in _pieces(data) if data is not None else ():
            held.append((piece, i, first))
            first += piece.count(b"\n") + 1
            size += len(piece)
            if size >= PIECE:
                yield parse()
                held, size = [], 0
    if held:
        yield parse()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _counted(documents: DataFrame, exact: bool) -> DataFrame:
    """whole (whether the key is of an exact line, else of a leaf), key, n (lines)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines, _, _ in _lines(batch, exact):
                for whole, keys in ((False, lines.leaf[lines.parsed]), *([(True, lines.whole)] if exact else [])):
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), whole)), _signed(keys), pa.array(n.astype(np.int64))], names=["whole", "key", "n"])

    return documents.select("text").mapInArrow(count, "whole boolean, key long, n long").groupBy("whole", "key").agg(F.sum("n").alias("n"))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.xxhash64("doc_id", "text").alias("row"), F.expr("try_cast(doc_id as bigint)").alias("doc"), "text")


LEAF_SCHEMA = "leaf long, row long, doc long, line int, n int, fields int, held array<long>"


def _leaf_lines(keyed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """LEAF_SCHEMA of the lines whose leaf may be wanted; held leaves out tokens with a digit."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = batch.column(0), batch.column(1)
            for lines, of, number in _lines(batch, False):
                at = lines.parsed[in_bitmap(wanted, lines.leaf[lines.parsed])]
                token = np.zeros(len(lines.held), bool)
                take = np.repeat(lines.first[at], lines.size[at]) + np.arange(lines.size[at].sum()) - np.repeat(np.cumsum(lines.size[at]) - lines.size[at], lines.size[at])
                token[take] = True
                held = _signed(lines.held[token & ~lines.field])
                ends = np.concatenate(([0], np.cumsum(lines.size[at] - lines.fields[at]))).astype(np.int32)
                where = pa.array(of[at])
                columns = [_signed(lines.leaf[at]), row.take(where), doc.take(where), *(pa.array(x[at].astype(np.int32)) for x in (number, lines.size, lines.fields)), pa.ListArray.from_arrays(pa.array(ends), held)]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "row", "doc", "line", "n", "fields", "held"])

    return keyed.mapInArrow(parse, LEAF_SCHEMA)


def _exact_lines(keyed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """key, row, doc, line of the lines that are not blank and whose hash may be wanted."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines, of, number in _lines(batch, True):
                met = in_bitmap(wanted, lines.whole)
                at = lines.solid[met]
                where = pa.array(of[at])
                yield pa.RecordBatch.from_arrays([_signed(lines.whole[met]), batch.column(0).take(where), batch.column(1).take(where), pa.array(number[at].astype(np.int32))], names=["key", "row", "doc", "line"])

    return keyed.mapInArrow(parse, "key long, row long, doc long, line int")


def _distinct_counts(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each entry the number of distinct rows that its key is met with."""
    order = np.lexsort((rows, keys))
    k, r = keys[order], rows[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    new = new_key | np.concatenate(([True], r[1:] != r[:-1])) if len(k) else new_key
    group = np.cumsum(new_key) - 1
    out = np.zeros(len(keys), np.int64)
    out[order] = np.bincount(group[new])[group] if len(k) else 0
    return out


def _dropped_of(table: pa.Table, rule: Rule) -> pa.RecordBatch:
    """row, line of the lines that whole leaves lose."""
    leaf, row = (table.column(c).to_numpy() for c in ("leaf", "row"))
    line, n, fields = (table.column(c).to_numpy().astype(np.int64) for c in ("line", "n", "fields"))
    doc = table.column("doc").combine_chunks()
    null = doc.is_null().to_numpy(zero_copy_only=False)
    doc = doc.fill_null(0).to_numpy()
    lists = table.column("held").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    held = lists.flatten().to_numpy().view(np.uint64)
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))))
    of = np.repeat(np.arange(len(leaf)), np.diff(ends))
    counts = _distinct_counts(held, row[of])
    documents = _distinct_counts(leaf, row)
    at, templates = [], []
    for share in rule.shares:
        constant = (counts >= LEAST_DOCUMENTS) & (100 * counts >= share * documents[of])
        total = np.concatenate(([0], np.cumsum(constant)))
        total = total[ends[1:]] - total[ends[:-1]]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(constant, held, np.uint64(0)), dtype=np.uint64)))
        follows = np.flatnonzero((total > 0) & (100 * (total + (fields if rule.fields_match else 0)) >= SHARE_PERCENT * n))
        at.append(follows)
        templates.append(stir((sums[ends[1:]] - sums[ends[:-1]])[follows] + leaf[follows].view(np.uint64) * _K[0]))
    at, templates = np.concatenate(at), np.concatenate(templates)
    met = _distinct_counts(templates, row[at]) >= LEAST_DOCUMENTS
    at, templates = at[met], templates[met]
    order = np.lexsort((row[at], line[at], doc[at], ~null[at], templates))
    at, templates = at[order], templates[order]
    first = np.flatnonzero(np.concatenate(([True], templates[1:] != templates[:-1]))) if len(at) else np.zeros(0, np.int64)
    keeper = np.repeat(at[first], np.diff(np.append(first, len(at))))
    gone = at[(row[at] != row[keeper]) | (line[at] != line[keeper])]
    return pa.RecordBatch.from_arrays([pa.array(row[gone]), pa.array(line[gone].astype(np.int32))], names=["row", "line"])


def _of_small_leaves(lines: DataFrame, rule: Rule) -> DataFrame:
    """row, line dropped, from leaves that are sorted together."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            leaves = table.column("leaf").to_numpy()
            whole = int(np.searchsorted(leaves, leaves[-1]))  # the last leaf may go on
            held = table.slice(whole)
            if whole:
                yield _dropped_of(table.slice(0, whole), rule)
        if held is not None:
            yield _dropped_of(held, rule)

    return lines.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(fold, "row long, line int")


def _of_large_leaves(lines: DataFrame, rule: Rule) -> DataFrame:
    """row, line dropped, counted token by token."""
    line = ["leaf", "row", "doc", "line", "n", "fields"]
    held = lines.select(*line, F.explode("held").alias("held"))
    counts = held.select("held", "row").distinct().groupBy("held").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= LEAST_DOCUMENTS)
    counts = common.materialize(counts, "leaf-tokens")
    documents = common.materialize(lines.select("leaf", "row").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("documents")), "leaf-documents")
    joined = held.join(counts, "held").join(documents, "leaf") if any(rule.shares) else held.join(counts, "held").withColumn("documents", F.lit(0))
    constant = {s: 100 * F.col("count") >= s * F.col("documents") for s in rule.shares}
    found = joined.groupBy(*line).agg(*[c for s in rule.shares for c in (F.bit_xor(F.when(constant[s], F.col("held"))).alias(f"template_{s}"), F.count_if(constant[s]).alias(f"constant_{s}"))])
    fields = F.col("fields") if rule.fields_match else F.lit(0)
    follows = [F.when((F.col(f"constant_{s}") > 0) & (100 * (F.col(f"constant_{s}") + fields) >= SHARE_PERCENT * F.col("n")), F.col(f"template_{s}")) for s in rule.shares]
    templated = found.select("row", "doc", "line", F.explode(F.array_compact(F.array_distinct(F.array(*follows)))).alias("template"), "leaf").withColumn("key", F.xxhash64("leaf", "template"))
    return _all_but_first(common.materialize(templated, "line-templates"), LEAST_DOCUMENTS)


def _all_but_first(lines: DataFrame, least_documents: int) -> DataFrame:
    """row, line of the lines (key, row, doc, line) in groups met in enough documents, without each group's
    first. What a group is joined with is written before, so that a hot group's join can be split."""
    per_row = lines.groupBy("key", "row").agg(F.min(F.struct("doc", "line", "row")).alias("first"))
    recurring = per_row.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("first").alias("first")).where(F.col("rows") >= least_documents)
    found = lines.join(common.materialize(recurring.select("key", "first"), "recurring"), "key").where((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    return found.select("row", "line")


def recurring_lines(documents: DataFrame, rule: Rule = RULE, gather_lines: int = GATHER_LINES) -> DataFrame:
    """row, drop (line numbers, from 0) of the rows that lose lines."""
    counted = common.materialize(_counted(documents, rule.exact).where(F.col("n") >= F.when(F.col("whole"), EXACT_DOCUMENTS).otherwise(LEAST_DOCUMENTS)), "line-keys")
    keyed = _keyed(documents)
    lines = common.materialize(_leaf_lines(keyed, bitmap(counted.where("not whole"), "key")), "leaf-lines")
    large = common.materialize(counted.where(~F.col("whole") & (F.col("n") > gather_lines)).select(F.col("key").alias("leaf")), "large-leaves")
    dropped = _of_small_leaves(lines.join(large, "leaf", "left_anti"), rule)
    if not large.isEmpty():
        dropped = dropped.unionByName(_of_large_leaves(common.materialize(lines.join(large, "leaf", "left_semi"), "large-leaf-lines"), rule))
    if rule.exact:
        exact = common.materialize(_exact_lines(keyed, bitmap(counted.where("whole"), "key")), "exact-lines")
        dropped = dropped.unionByName(_all_but_first(exact, EXACT_DOCUMENTS))
    out = common.materialize(dropped.groupBy("row").agg(F.collect_set("line").alias("drop")), "dropped-lines")  # of one text
    common.discard(counted, lines)
    return out


def _without_lines(documents: DataFrame, rule: Rule) -> tuple[DataFrame, str, str, str]:
    """The documents with three columns appended, whose names follow: the number of lines, what is left
    of the text, and the numbers of the lines that went."""
    row, lines, left, drop = common.spare_names(documents, "row", "lines", "left", "drop")
    gone = recurring_lines(documents.select("doc_id", "text"), rule).select(F.col("row").alias(row), F.col("drop").alias(drop))
    # lost lines grow with the corpus, so they are never broadcast: each text is shuffled once at any size
    joined = documents.withColumn(row, F.xxhash64("doc_id", "text")).join(gone.hint("merge"), row, "left").drop(row)
    split = F.split("text", "\n")
    rest = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda _, i: ~F.array_contains(drop, i)), "\n"))
    return joined.withColumn(lines, F.coalesce(F.size(split), F.lit(0))).withColumn(left, rest), lines, left, drop


def drop_recurring(documents: DataFrame, *, keep_emptied: bool = True, rule: Rule = WIDE_RULE) -> DataFrame:
    """The documents, same rows and columns, without the lines that recur at any size. A column
    n_chars, where there is one, is the new text's length. Without `keep_emptied`, rows whose lines were
    all dropped (whole copies) go."""
    columns = documents.columns
    found, _, left, drop = _without_lines(documents, rule)
    found = found.withColumn("text", F.col(left))
    if not keep_emptied:
        found = found.where(F.col(drop).isNull() | (F.btrim("text", F.lit(BLANK + "\n")) != ""))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in columns])


def dedup_lines(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text left of every document."""
    found, lines, left, drop = _without_lines(documents.select("doc_id", "text"), RULE)
    return found.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col(lines)).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"), F.col(left).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
  FROM documents WHERE text IS NOT NULL
), toks AS (
  SELECT doc_id, ln, string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\v\f\r]+') AS w FROM lines
), parsed AS (
  SELECT doc_id, ln, w, len(w) AS n,
    CASE WHEN regexp_matches(w[1], '[0-9]') THEN '<*>' ELSE w[1] END AS a,
    CASE WHEN regexp_matches(w[2], '[0-9]') THEN '<*>' ELSE w[2] END AS b
  FROM toks WHERE len(w) >= 3
), leaves AS (SELECT n, a, b FROM parsed GROUP BY ALL HAVING count(DISTINCT doc_id) >= 4),
kept AS (SELECT p.* FROM parsed p JOIN leaves USING (n, a, b)),
ex AS (
  SELECT * FROM (SELECT doc_id, ln, n, a, b, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM kept) WHERE NOT regexp_matches(t, '[0-9]')
), constant AS (SELECT n, a, b, p, t FROM ex GROUP BY ALL HAVING count(DISTINCT doc_id) >= 4),
tpl AS (
  SELECT doc_id, ln, n, a, b, string_agg(p || ':' || t, ' ' ORDER BY p) AS template, count(*) AS k
  FROM ex JOIN constant USING (n, a, b, p, t) GROUP BY doc_id, ln, n, a, b HAVING 100 * count(*) >= 60 * n
), rec AS (
  SELECT n, a, b, template, min({'d': doc_id, 'l': ln}) AS f FROM tpl GROUP BY ALL HAVING count(DISTINCT doc_id) >= 4
), gone AS (
  SELECT doc_id, ln FROM tpl JOIN rec USING (n, a, b, template) WHERE doc_id <> f.d OR ln <> f.l
), whole AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.ln) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (g.ln IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.ln = l.ln GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, whole.text
FROM documents d LEFT JOIN whole USING (doc_id)
"""
