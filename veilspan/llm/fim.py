"""Fill-in-the-middle documents: a text's middle moved to its end, behind sentinels, for some documents.

The cut points count tokens (`PATTERN`). A Split pre-tokenizer of the tokenizers library, which is not
trained, isolates every match of the pattern and gives its code-point offsets; their number is n, and the
offsets of the chosen ranks cut the text into prefix, middle and suffix. What is drawn for a document
hangs on the seed and its doc_id alone, so a lost task's work is repeated alike. Each text is handled in
its own row: nothing is shuffled. `restored` rebuilds texts in column expressions.

Cases: a null text is empty; an empty text, and one that holds a sentinel, is left plain. A null doc_id
is hashed as no digits. Very long texts are cut into pieces of about PIECE characters that end where a
token does, so the offsets are those of the whole text. Repeated rows have equal results. Extra columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

#: A token: white space with the word it leads, or white space at the end.
PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Characters of a piece; a token of the text ends where a word does and white space follows.
PIECE, TOKEN_END = 1 << 20, re.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Plan:
    """Percent of documents that are rearranged, percent of those with the suffix first, and the sentinels."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        # Then a sentinel can begin nowhere but where one was put, whatever text stands before it.
        first, rest = {s[:1] for s in self.sentinels}, "".join(s[1:] for s in self.sentinels)
        if len(set(self.sentinels)) != 3 or "" in first or any(c in rest for c in first):
            raise ValueError("three sentinels are wanted whose first characters occur in them at the start only")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def token_offsets(splitter, text: str) -> np.ndarray:
    """[token, (start, end)] in code points of the whole text."""
    found, at = [np.zeros((0, 2), np.int64)], 0
    while at < len(text):
        end = TOKEN_END.search(text, at + PIECE)
        end = end.start() if end else len(text)
        own = [o for _, o in splitter.pre_tokenize_str(text if end - at == len(text) else text[at:end])]
        found.append(np.array(own, np.int64) + at)
        at = end
    return np.concatenate(found)


def _drawn(plan: Plan, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(plan: Plan, doc_id: int | None, text: str, offsets: np.ndarray) -> tuple[str, int | None, int | None, str]:
    """form, prefix_chars, middle_chars and output of one text."""
    n = len(offsets)
    a, b, draw, order = _drawn(plan, doc_id)
    if not text or any(s in text for s in plan.sentinels) or draw % 100 >= plan.rate:
        return "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    i, j = (int(offsets[k - 1, 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if order % 100 < plan.suffix_first:
        return "spm", i, j - i, f"{plan.suffix}{suffix}{plan.prefix}{prefix}{plan.middle}{middle}"
    return "psm", i, j - i, f"{plan.prefix}{prefix}{plan.suffix}{suffix}{plan.middle}{middle}"


def transform(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        splitter = pre_tokenizers.Split(Regex(PATTERN), "isolated")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                offsets = token_offsets(splitter, text)
                rows.append((doc_id, len(offsets), *rearrange(plan, doc_id, text, offsets)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", plan: Plan = Plan()) -> Column:
    """The text that an output of that form was made from."""
    part = F.split(output, "|".join(rf"\Q{s}\E" for s in plan.sentinels))
    of_psm, of_spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", of_psm).when(F.col(form) == "spm", of_spm).otherwise(F.col(output))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(common.table(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: The contract's rule on lists of regular-expression matches; what is restored has to be the text.
SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents
), drawn AS (
  SELECT doc_id, text, w, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM texts
), cut AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
