"""Corpora and models."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from veilspan.operators import corpora
from veilspan.plans import evaluation


def test_draws_are_repeatable_and_distinct(spark):
    draws = spark.range(400).withColumnRenamed("id", "draw")
    once = corpora.sampled(draws, "draw", ["a {x}", "b {x} {y}"], {"x": list("pqr"), "y": list("st")}, 42).collect()
    again = corpora.sampled(draws.repartition(7), "draw", ["a {x}", "b {x} {y}"], {"x": list("pqr"), "y": list("st")}, 42).collect()
    assert sorted(once) == sorted(again) and {r["text"] for r in once} == {f"a {x}" for x in "pqr"} | {f"b {x} {y}" for x in "pqr" for y in "st"}
    assert sorted(once) != sorted(corpora.sampled(draws, "draw", ["a {x}", "b {x} {y}"], {"x": list("pqr"), "y": list("st")}, 43).collect())


def test_tfidf_equals_plain_counts(spark):
    texts = {1: "the cat sat on the mat", 2: "The dog sat", 3: "a b", 4: None, 5: "", 6: "cat cat cat"}
    got = corpora.tfidf(spark.createDataFrame(list(texts.items()), "k long, text string"), "k").collect()
    grams = {}
    for k, t in texts.items():
        words = re.findall(r"\b\w\w+\b", (t or "").lower())
        grams[k] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    df = Counter(t for g in grams.values() for t in g)
    for k, g in grams.items():
        raw = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in g.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        own = {r["term"]: r for r in got if r["k"] == k}
        assert set(own) == set(raw) and all(abs(own[t]["weight"] - w / length) < 1e-12 and own[t]["df"] == df[t] for t, w in raw.items())


def test_confusion_counts(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", None), (None, "d")], "l string, p string")
    got = {r["class"]: tuple(r)[1:] for r in corpora.confusion(rows, "l", "p").collect()}
    assert got == {"a": (1, 0, 2, 1.0, 0.333333), "b": (1, 2, 0, 0.333333, 1.0), "c": (0, 0, 1, 0.0, 0.0), "d": (0, 1, 0, 0.0, 0.0)}


def test_the_model_finds_attacks_worded_otherwise(spark, tmp_path):
    spark.range(600).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["class"]: r for r in evaluation.injection_evaluation(spark, str(tmp_path)).collect()}
    assert got["attack"]["recall"] >= 0.9 and got["benign"]["recall"] >= 0.8 and got["attack"]["tp"] > 20
