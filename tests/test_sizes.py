"""What larger tables and odd values have shown: rows that small tables do not hold."""

import hashlib
import hmac
import time

import duckdb
from pyspark.sql import functions as F

from veilspan.functions import expressions as E
from veilspan.functions import fixed
from veilspan.operators import corpora, guard, stored, sweep
from veilspan.plans import evaluation, registry


def test_costs_next_to_a_tie_are_rounded_as_sql_does(spark, tmp_path):
    prices = [65450.0, 32350.0, 300650.0, 150.0, 50.0, 49.0, 0.0, 12345.67]
    spark.createDataFrame([(i + 1, p) for i, p in enumerate(prices)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    wanted = duckdb.sql(registry.oracle_sql()["audit_view"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    got = registry.queries()["audit_view"](spark, str(tmp_path)).select("request_id", "decision", "rule", F.col("user"), "model", "detail").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_tool_calls_are_scanned_once_and_on_all_cores(spark, tmp_path):
    """One small file is one task unless its rows are dealt; a join of the rows with what their calls decide scans twice."""
    args = [(i % 2, "web_search" if i % 2 else "bash", "query" if i % 2 else "command", "mail a@x.org", "s") for i in range(4)] + [(7, "calendar", "title", None, "s")]
    spark.createDataFrame(args, "call long, tool string, arg string, value string, session string").coalesce(1).write.parquet(str(tmp_path / "args"))
    rules = spark.createDataFrame(list(fixed.TOOL_RULES), "tool string, arg string, rule string")
    done = guard.scan_calls(spark.read.parquet(str(tmp_path / "args")), "call", rules, session="session", secret="k")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[found(") == 1 and "Repartition 4" in plan
    assert sorted((r["call"], r["outcome"], (r["rewritten"] or "-")[:9]) for r in done.collect()) == [(0, "refused", "-")] * 2 + [(1, "rewritten", "mail [PII")] * 2 + [(7, "passed", "-")]
    rows = spark.createDataFrame([(1, "s", "mail a@x.org"), (1, "s", "card 4111 1111 1111 1111"), (2, "s", "mail a@x.org")], "request long, session string, text string")
    clean = guard.sanitize(rows, "request", fixed.POLICIES["default"], session="session", secret="k")
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("[found(") == 1
    assert sorted((r["request"], r["blocked"], r["notice"] is None) for r in clean.collect()) == [(1, ["CREDIT_CARD"], True)] * 2 + [(2, [], False)]


def test_keyed_hashes_are_those_of_the_library(spark):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)] + ["00" * 32, "36" * 32, "5c" * 32, "ff" * 32, "80" + "00" * 31]
    rows = spark.createDataFrame([(k, f"v{i}é") for i, k in enumerate(keys)], "k string, v string").withColumn("h", E.hmac_sha256(F.col("k"), F.col("v")))
    assert all(r["h"] == hmac.new(bytes.fromhex(r["k"]), r["v"].encode(), hashlib.sha256).hexdigest() for r in rows.collect())
    assert "transform(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_ends_are_looked_for_behind_marks():
    text = "words of a text that goes on " * 6000 + "e.g. this. And that!! 'So.' End"
    began = time.process_time()
    ends = [m.end() for m in sweep.compiled(sweep.BOUNDARY).finditer(text)]
    plain, began = time.process_time() - began, time.process_time()
    found = sweep.sentences_in(text)
    assert time.process_time() - began < plain / 3
    assert found == list(zip([0, *ends], [*ends, len(text)], strict=True)) and len(found) == 4


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vocabularies_are_not_broadcast(spark):
    found = corpora.tfidf(spark.createDataFrame([(1, "aa bb"), (2, "bb cc")], "k long, text string"), "k")
    assert "BroadcastHashJoin" not in _joins(found) and found.count() == 6


def test_stored_keys_are_not_broadcast(spark):
    rows, held = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (None,)], "k long")
    fresh = stored.unheld(rows, held, ["k"])
    assert "Broadcast" not in _joins(fresh) and [r["k"] for r in fresh.collect()] == [1]


def test_a_model_is_fitted_on_a_corpus_drawn_once(spark, monkeypatch, tmp_path):
    spark.range(40).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    fitted = []
    plain = corpora.injection_model
    monkeypatch.setattr(corpora, "injection_model", lambda labelled: fitted.append(labelled) or plain(labelled))
    assert evaluation.injection_evaluation(spark, str(tmp_path)).count() == 2
    assert "sha2" not in fitted[0]._jdf.queryExecution().optimizedPlan().toString()
