"""Queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from veilspan.llm import classifier, codes, fim, grammar, langid, lines, mixing, neardup, neighbours, ngramjoin, packing, rules, suffixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeated_strings": suffixes.query,
        "op2_near_duplicates": neardup.query,
        "op3_line_templates": lines.query,
        "op4_quality_classifier": classifier.query,
        "op5_quality_rules": rules.query,
        "op6_token_grammar": grammar.query,
        "op7_pack_sequences": packing.query,
        "op8_language_id": langid.query,
        "op9_nearest_neighbours": neighbours.query,
        "op10_mix_domains": mixing.query,
        "op11_ngram_join": ngramjoin.query,
        "op12_fill_in_middle": fim.query,
        "op13_vector_codes": codes.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_duplicates": neardup.SQL,
        "op3_line_templates": lines.SQL,
        "op11_ngram_join": ngramjoin.SQL,
        "op12_fill_in_middle": fim.SQL,
        "op13_vector_codes": codes.SQL,
    }
