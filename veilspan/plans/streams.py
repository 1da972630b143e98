"""Streaming queries: the stream is driven to its end over the input and its sink read as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed
from veilspan.plans import control
from veilspan.session import shared_folder, spread, table
from veilspan.streaming import limits, rehydrate

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Drive an append stream over all that is there and read what it wrote."""
    folder = _folder(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _as_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = _folder(spark)
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query(
    "stream_rehydrate",
    "SELECT c_custkey::VARCHAR AS request_id, 'Hello ' || c_name || ' and [UNRESOLVED_PII_TOKEN]; 1 < 2.' AS final_text, 1::BIGINT AS unresolved FROM customer",
)
def stream_rehydrate(spark: SparkSession, sf: str) -> DataFrame:
    """Replies cut in four-character chunks, rehydrated chunk by chunk and joined again."""
    identity = F.substring(F.sha2("c_name", 256), 1, 10)
    reply = F.concat(F.lit("Hello <PERSON_PII_"), identity, F.lit("> and <EMAIL_PII_0000000000>; 1 < 2."))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("request_id"), reply.alias("text"), F.array(identity).alias("token_ids"), F.array("c_name").alias("values_"))
    cut = _chunks(rows)
    released = _run(spark, rehydrate.rehydrate_stream(_as_stream(spark, cut)))
    return _joined(released).select("request_id", "final_text", "unresolved")


def _joined(released: DataFrame) -> DataFrame:
    """Each request's released text in order of its chunks; only chunks that released some are gathered. `early`: some came
    before the last chunk."""
    some = F.col("released") != ""
    parts = F.array_sort(F.collect_list(F.when(some, F.struct("chunk_no", "released"))))
    early = F.coalesce(F.min(F.when(some, F.col("chunk_no"))) < F.max("chunk_no"), F.lit(False))
    rows = released.groupBy("request_id").agg(parts.alias("parts"), F.sum("unresolved").alias("unresolved"), early.alias("early"))
    return rows.select("request_id", F.array_join(F.transform("parts", lambda p: p["released"]), "").alias("final_text"), "unresolved", "early")


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks of four characters; the vault entries come with the first."""
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,4}"), F.lit(0))
    closed = F.col("output_ids") if "output_ids" in rows.columns else F.expr("cast(array() as array<string>)")
    cut = spread(rows).withColumn("output_ids", closed).withColumn("n", F.size(pieces)).select("request_id", "n", "token_ids", "values_", "output_ids", F.posexplode(pieces).alias("chunk_no", "piece"))
    first = lambda c: F.when(F.col("chunk_no") == 0, F.col(c)).otherwise(F.slice(c, 1, 0)).alias(c)
    return cut.select("request_id", "chunk_no", "piece", (F.col("chunk_no") == F.col("n") - 1).alias("last"), *[first(c) for c in ("token_ids", "values_", "output_ids")])


_SAID = "'All good here for now. Mail c' || c_custkey || '@mail.com or ask <PERSON_PII_' || {} || '> about it. Thanks for that. The host is 10.1.' || (c_custkey % 200) || '.7 today. Bye'"


@query(
    "stream_output_scan",
    "SELECT c_custkey::VARCHAR AS request_id, '[CONTEXT_SUPPRESSED]Mail <EMAIL> or ask ' || c_name || ' about it. [CONTEXT_SUPPRESSED]The host is [REDACTED_OUTPUT_IP_ADDRESS] today. [CONTEXT_SUPPRESSED]' AS final_text, 0::BIGINT AS unresolved, 1::BIGINT AS parts FROM customer",
)
def stream_output_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in chunks of four characters, scanned under the strict policy while they arrive: leaked values are marked or
    become tokens (shown by their label), the sentences beside them are blanked, the input's own tokens are opened.
    `parts` is 1 where text was released before the last chunk."""
    identity = F.substring(F.sha2("c_name", 256), 1, 10)
    reply = F.expr(_SAID.format("substr(sha2(c_name, 256), 1, 10)"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("request_id"), reply.alias("text"), F.array(identity).alias("token_ids"), F.array("c_name").alias("values_"))
    cut = _chunks(rows).withColumn("session_id", F.lit("s")).drop("output_ids")
    scan = rehydrate.Scan(fixed.POLICIES["finance_strict"], "local-test-secret", suppress_context=True)
    released = _run(spark, rehydrate.scan_stream(_as_stream(spark, cut), scan))
    text = F.regexp_replace("final_text", r"<EMAIL_PII_[0-9a-f]{10}>", "<EMAIL>")
    return _joined(released).select("request_id", text.alias("final_text"), "unresolved", F.col("early").cast("long").alias("parts"))


@query("stream_dedupe", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", F.to_timestamp("ts").alias("ts"))
    doubled = rows.unionByName(rows.where("event_id % 2 = 0"))
    seen = _run(spark, rehydrate.dedupe_stream(_as_stream(spark, doubled), "event_id", "ts", "60 days"))
    return seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "events").select("event_id", "user_id", "value", F.to_timestamp("ts").alias("ts")))
    return rows.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e6).alias("at"), "ts", (F.col("value") < 60).alias("failed"))


#: Key of the row that ends a bounded stream, and how long after the last row it comes.
_END, _AFTER = "(end)", "interval 1 day"


def _ended(rows: DataFrame) -> DataFrame:
    """The rows and one more, later than all, after which the watermark has passed them."""
    last = rows.agg(F.max("ts").alias("ts")).withColumn("ts", F.col("ts") + F.expr(_AFTER))
    values = {"key": F.lit(_END), "id": F.lit(-1).cast("long"), "ts": F.col("ts"), "at": F.unix_micros("ts") / 1e6}
    return rows.unionByName(last.select(*[values.get(c, F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes]))


@query("stream_token_bucket", control.SQL["token_bucket"])
def stream_token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    rows = _as_stream(spark, _ended(_calls(spark, sf).select("key", "id", "at", "ts")))
    found = _run(spark, limits.limit_stream(rows, 0.00001, 3.0)).where(F.col("key") != _END)
    return found.select(F.col("id").alias("event_id"), "allowed")


@query("stream_circuit_breaker", control.SQL["circuit_breaker"])
def stream_circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    rows = _as_stream(spark, _ended(_calls(spark, sf)))
    found = _run(spark, limits.guard_stream(rows, 5, 86400.0)).where(F.col("key") != _END)
    return found.groupBy(F.col("key").cast("long").alias("user_id"), "state").agg(F.count(F.lit(1)).alias("n"))


@query("stream_offline", "WITH b AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY 1) SELECT user_id, last + 43200000 AS due_ms FROM b WHERE last + 43200000 <= (SELECT max(last) FROM b)")
def stream_offline(spark: SparkSession, sf: str) -> DataFrame:
    """Agents whose third heartbeat in a row is missing when the stream ends."""
    rows = _as_stream(spark, _calls(spark, sf).select("key", "id", "at", "ts"))
    return _run(spark, limits.offline_stream(rows, 14400.0, 3)).select(F.col("key").cast("long").alias("user_id"), "due_ms")


@query("stream_expiry", "WITH l AS (SELECT user_id, arg_max(epoch_us(ts) // 1000 + 60000 * (event_id % 200), (ts, event_id)) AS due_ms FROM events GROUP BY 1) SELECT user_id, due_ms FROM l WHERE due_ms <= (SELECT max(epoch_us(ts) // 1000) FROM events)")
def stream_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Vault entries (one for each user, the last write counts) that have expired when the stream ends."""
    until = F.unix_millis("ts") + 60000 * (F.col("id") % 200)
    rows = _as_stream(spark, _calls(spark, sf).select("key", "id", "at", "ts", until.alias("until_ms")))
    return _run(spark, limits.expiry_stream(rows)).select(F.col("key").cast("long").alias("user_id"), "due_ms")
