"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes all that its predecessor kept, as Parquet, and returns a DataFrame; all but the last
return the columns of `documents`. Columns besides, whatever their names, are carried to the last stage,
which returns pieces. Every stage gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan.llm import common, langid, lines, mixing, neardup, packing


#: Least similarity of near duplicates; op2's 85 percent is the contract of its query alone.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; those predicted `und`, or far from every profile, go.

    A null, empty or letterless text is `und`. Repeated rows are judged alike; a null doc_id or lang is
    judged as any other but teaches nothing. Equal distances go to the language that sorts first."""
    common.prepare(spark)
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that recur; those left without any line go.

    A null text has no lines and stays; repeated rows count as one document and lose the same lines; of
    equal lines the one with the smallest doc_id (null first), then line number, stays."""
    common.prepare(spark)
    return lines.drop_recurring(docs, keep_emptied=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked from NEAR_PERCENT similar shingles on.

    Texts without words are linked with nothing and stay; so does every row without doc_id. Repeated rows
    of the doc_id that stays all stay."""
    common.prepare(spark)
    return neardup.keep_one(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the domains' tokens have their target weights; only those of a
    domain with fewer tokens than its target are repeated.

    A null or empty text has no tokens and the prior's posteriors. Without labels every document is kept
    once. Repeated rows have equal copies; a null doc_id is hashed as a key of its own."""
    return mixing.mix(docs, common.table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 1,024 tokens.

    A null or empty text is the end token alone. Repeated rows are packed once for each row. A null doc_id
    is carried."""
    common.prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL has no tokenizer, so the last stage cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
