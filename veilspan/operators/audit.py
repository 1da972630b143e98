"""The hash-chained audit table: canonical rows, chaining, parallel verification, evidence, views.

A chain is serial by nature: one fold for each chain id, along its order, with the last hash as its only state.
A log is sharded by its origin, so chains are many; verifying needs no fold, only each row and its
predecessor's hash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from veilspan import session
from veilspan.functions import ed25519
from veilspan.operators import folds


def canonical(fields: list[str], omit_null: tuple[str, ...] = ()) -> Column:
    """name=length:value of each field in order; a null is `name=-`, or left out for `omit_null`."""
    parts = []
    for f in sorted(fields):
        value = F.col(f).cast("string")
        shown = F.concat(F.lit(f"{f}="), F.length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(shown, F.lit(None).cast("string") if f in omit_null else F.lit(f"{f}=-")))
    return F.concat_ws("|", *parts)


def link(records: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """Records with prev_hash and hash: hash = sha256(prev_hash + body), along `order` in each chain."""

    def step(state: dict, own: str | None) -> tuple[str | None, str]:
        last = state.get("last")
        state["last"] = hashlib.sha256(((last or "") + (own or "")).encode()).hexdigest()
        return last, state["last"]

    return folds.fold(records, chain, [order], [body], dict, step, {"prev_hash": ("string", pa.string()), "hash": ("string", pa.string())})


def rechain(records: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """Records linked anew, with `changed`; records that carry a signature are refused, since their hashes are signed."""
    if "signature" in records.columns:
        refused = F.when(F.col("signature").isNotNull(), F.raise_error(F.lit("a signed record cannot be linked anew")).cast("string")).otherwise(F.col("hash"))
        records = records.withColumn("hash", refused)
    kept = records.withColumnRenamed("hash", "old_hash").drop("prev_hash")
    return link(kept, chain, order, body).withColumn("changed", ~F.col("hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")


def verify(records: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """n, ok and first_bad of each chain, from each row and the hash before it."""
    return _verified(records, chain, order, body).drop("head")


def _verified(records: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """What `verify` and `heads` give, in one pass over the records."""
    w = Window.partitionBy(chain).orderBy(order)
    linked = F.col("prev_hash").eqNullSafe(F.lag("hash").over(w))
    right = F.col("hash") == F.sha2(F.concat(F.coalesce("prev_hash", F.lit("")), F.col(body)), 256)
    checked = records.withColumn("good", linked & right)
    first_bad = F.min(F.when(~F.col("good"), F.col(order)))
    return checked.groupBy(chain).agg(F.count(F.lit(1)).alias("n"), F.bool_and("good").alias("ok"), first_bad.alias("first_bad"), F.max_by("hash", order).alias("head"))


def heads(records: DataFrame, chain: str, order: str) -> DataFrame:
    """chain, n and head (the last record's hash) of each chain: what is signed."""
    return records.groupBy(chain).agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", order).alias("head"))


def _message(chain: str | None, n: int, head: str | None) -> bytes:
    return f"{chain}|{n}|{head}".encode()


def sign_heads(heads: DataFrame, chain: str, seed: bytes, key_id: str) -> DataFrame:
    """Heads with key_id and signature (hex), a detached Ed25519 signature of chain, length and head."""
    session.ship_package(heads.sparkSession)

    @F.arrow_udf(StringType())
    def signed(chains: pa.Array, counts: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = zip(chains.to_pylist(), counts.to_pylist(), hashes.to_pylist(), strict=True)
        return pa.array([ed25519.sign(_message(*row), seed).hex() for row in rows], pa.string())

    return heads.withColumn("key_id", F.lit(key_id)).withColumn("signature", signed(F.col(chain).cast("string"), "n", "head"))


def verify_signed(records: DataFrame, signed: DataFrame, keys: DataFrame, chain: str, order: str, body: str, *, require_signature: bool = True) -> DataFrame:
    """n, ok, first_bad and signature of each chain: `valid`, `missing`, `unknown key`, or `invalid` where a head, the
    number of records, or the signature itself is another than was signed. Any but `valid` makes a chain not ok; a missing
    one only if signatures are required.

    A record that was altered together with all hashes after it still links, but its head is not the signed one. A chain that
    is signed and of which no record is left is `invalid` too, with n = 0.
    `keys` (key_id, public_key in hex) holds the keys of all rotations; signatures name theirs."""
    session.ship_package(records.sparkSession)

    @F.arrow_udf(BooleanType())
    def good(chains: pa.Array, counts: pa.Array, hashes: pa.Array, signatures: pa.Array, publics: pa.Array) -> pa.Array:
        def right(chain: str, n: int, head: str, signature: str | None, key: str | None) -> bool:
            try:
                return signature is not None and key is not None and ed25519.verified(_message(chain, n, head), bytes.fromhex(signature), bytes.fromhex(key))
            except ValueError:
                return False

        rows = zip(*(x.to_pylist() for x in (chains, counts, hashes, signatures, publics)), strict=True)
        return pa.array([right(*row) for row in rows], pa.bool_())

    held = signed.select(F.col(chain).alias("signed_chain"), "key_id", "signature").withColumn("held", F.lit(True))
    now = _verified(records, chain, order, body)
    both = now.join(held, F.col(chain).eqNullSafe(F.col("signed_chain")), "full").join(F.broadcast(keys.select("key_id", "public_key")), "key_id", "left")
    lost = F.col("n").isNull()
    joined = both.withColumns({chain: F.coalesce(chain, "signed_chain"), "n": F.coalesce("n", F.lit(0)), "ok": F.col("ok") & ~lost})
    state = (
        F.when(F.col("held").isNull() | F.col("signature").isNull(), "missing")
        .when(F.col("public_key").isNull(), "unknown key")
        .when(good(F.col(chain).cast("string"), "n", "head", "signature", "public_key"), "valid")
        .otherwise("invalid")
    )
    checked = joined.select(chain, "n", "ok", "first_bad", state.alias("signature"))
    accepted = F.col("signature").isin("valid", *([] if require_signature else ["missing"]))
    return checked.withColumn("ok", F.col("ok") & accepted)


def view(records: DataFrame) -> DataFrame:
    """The flat record shown to an administrator: decision, rule, who, model, detail."""
    labels = F.concat(F.map_keys("span_counts"), F.coalesce("blocked_labels", F.array().cast("array<string>")))
    rule = F.when(F.array_contains(labels, "SECRET"), "SECRET_SCAN").when(F.array_contains(labels, "PROMPT_INJECTION"), "CODE_VULN").otherwise("PII_SCAN")
    decision = F.when(F.col("event") == "blocked", "BLOCKED").when(F.coalesce("redacted_count", F.lit(0)) > 0, "REDACTED").otherwise("ALLOWED")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    detail = F.concat_ws(
        " · ", F.concat(F.lit("event="), "event"),
        F.when(F.size("blocked_labels") > 0, F.concat(F.lit("blocked=["), F.array_join("blocked_labels", ", "), F.lit("]"))),
        F.when(F.col("redacted_count") > 0, F.concat(F.lit("redacted_spans="), F.col("redacted_count").cast("string"))),
        F.concat(F.lit("provider="), some("provider")),
        F.when(F.col("cost_usd") > 0, F.concat(F.lit("cost=$"), F.format_string("%.4f", F.col("cost_usd")))),
    )
    return records.select("request_id", decision.alias("decision"), rule.alias("rule"), F.coalesce(some("team_id"), some("key_id"), F.lit("unknown")).alias("user"), F.coalesce(some("model_id"), some("difficulty"), F.lit("n/a")).alias("model"), detail.alias("detail"))


def evidence(records: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """One manifest row: record_count and whether every chain verifies."""
    return verify(records, chain, order, body).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("chain_verified"))


def bundle(records: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """The lines of an evidence bundle, as JSON: the manifest (line 0), then the records in order of chain and `order`,
    each with its place in its chain from 1."""
    manifest = evidence(records, chain, order, body).select(F.lit("").alias("chain"), F.lit(0).cast("long").alias("line"), F.to_json(F.struct("record_count", "chain_verified")).alias("json"))
    place = F.row_number().over(Window.partitionBy(chain).orderBy(order)).cast("long")
    rows = records.select(F.col(chain).cast("string").alias("chain"), place.alias("line"), F.to_json(F.struct(*records.columns)).alias("json"))
    return manifest.unionByName(rows)


def write_jsonl(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, *, require_signature: bool = False) -> DataFrame:
    """Records of JSON lines; blank lines are skipped. With `require_signature` an unsigned record ends the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    if not require_signature:
        return rows
    signed = F.when(F.col("signature").isNull(), F.raise_error(F.concat(F.lit("unsigned record "), F.coalesce(F.col("record_id"), F.lit("?")))).cast("string")).otherwise(F.col("signature"))
    return rows.withColumn("signature", signed)
