"""The token vault as tables: minting, encrypting, upserting, expiry, erasure and rehydration."""

from __future__ import annotations

import os
import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from veilspan import session as session_
from veilspan.functions import expressions as E
from veilspan.functions import fixed


def mint(decisions: DataFrame, session: str, secret: str) -> DataFrame:
    """token_id and token of spans to be replaced."""
    acted = decisions.where(F.col("action").isin("REVERSIBLE", "BLOCK")).withColumn("token_id", E.token_id(F.col(session), secret, F.col("text")))
    return acted.withColumn("token", E.token(F.col("label"), F.col("token_id")))


def _place(session: Column, token_id: Column) -> Column:
    return F.concat_ws(":", session, token_id)


def sealed(value: Column, key: Column, session: Column, token_id: Column) -> Column:
    """AES-256-GCM of the value with session and token as authenticated data; the nonce is the head of
    a hash of key, place and value, so equal entries are equal bytes."""
    place = _place(session, token_id)
    nonce = F.unhex(F.substring(F.sha2(F.concat(F.hex(key), place, value), 256), 1, 24))
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, place)


def opened(ciphertext: Column, key: Column, session: Column, token_id: Column) -> Column:
    return F.aes_decrypt(ciphertext, key, F.lit("GCM"), F.lit("DEFAULT"), _place(session, token_id)).cast("string")


def at_place(left: DataFrame, right: DataFrame, how: str = "inner", on: tuple[str, ...] = ("session_id", "token_id")) -> DataFrame:
    """The rows of both at one place. A place without a session or a token is a place too: null meets null."""
    named = right.withColumnsRenamed({c: f"{c}__" for c in on})
    return left.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in on]), how).drop(*(f"{c}__" for c in on))


def parted(entries: DataFrame) -> DataFrame:
    """Entries (session_id, token_id, value and more) with a place for each value. A token is ten hex digits of a folded value's
    hash, so different values can have the same one: of those in one session all but the least get their number behind it.

    Only values that share a token are joined back, as a rule none; equal values are counted once, however many they are."""
    place = Window.partitionBy("session_id", "token_id").orderBy("value")
    values = entries.select("session_id", "token_id", "value").distinct().withColumn("no", F.row_number().over(place) - 1)
    numbered = at_place(entries, values.where("no > 0"), "left", ("session_id", "token_id", "value"))
    longer = F.concat(F.coalesce("token_id", F.lit("")), F.lit("~"), F.col("no").cast("string"))
    return numbered.withColumn("token_id", F.coalesce(longer, "token_id")).select(entries.columns)


def _random(count: int) -> list[bytes]:
    return [os.urandom(32) for _ in range(count)]


@F.arrow_udf(BinaryType())
def _own_keys(places: pa.Array) -> pa.Array:
    return pa.array(_random(len(places)), pa.binary())


def seal_entries(entries: DataFrame, master: Column, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries (session_id, token_id, value) as two tables in `folder`: boxes (session_id, token_id, box), each value under
    a random key of its own, and keys (session_id, token_id, wrapped), those keys under the master key. Both are bound
    to session and token. No key follows from the master key, so a box whose key row is gone is closed for good.
    Entries of one session and token are one entry (the least value, should values differ: `parted` gives each its own place), so
    each place has one box and one key.

    The keys are drawn in the one job that writes both in one row, so a task that is repeated writes a pair that fits."""
    session_.ship_package(entries.sparkSession)
    place = _place(F.col("session_id"), F.col("token_id"))
    once = entries.groupBy("session_id", "token_id").agg(F.min("value").alias("value"))
    drawn = once.withColumn("own", _own_keys.asNondeterministic()(place))
    rows = drawn.select("session_id", "token_id", _encrypted(F.col("value"), F.col("own"), place).alias("box"), _encrypted(F.hex("own"), master, place).alias("wrapped"))
    both = _stored(rows, f"{folder}/sealed")
    return _stored(both.drop("wrapped"), f"{folder}/boxes"), _stored(both.drop("box"), f"{folder}/keys")


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _encrypted(value: Column, key: Column, place: Column) -> Column:
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), place)


def _decrypted(box: Column, key: Column, place: Column) -> Column:
    return F.try_aes_decrypt(box, key, F.lit("GCM"), F.lit("DEFAULT"), place).cast("string")


def open_entries(boxes: DataFrame, keys: DataFrame, master: Column) -> DataFrame:
    """session_id, token_id, value of every box; null where its key is gone or another master key wrapped it."""
    place = _place(F.col("session_id"), F.col("token_id"))
    own = F.unhex(_decrypted(F.col("wrapped"), master, place))
    joined = at_place(boxes, keys, "left").withColumn("own", own)
    return joined.select("session_id", "token_id", F.when(F.col("own").isNotNull(), _decrypted(F.col("box"), F.col("own"), place)).alias("value"))


def rewrap(keys: DataFrame, old: Column, new: Column) -> DataFrame:
    """Keys wrapped under a new master key; boxes stay as they are. Keys that the old master key does not open are dropped."""
    place = _place(F.col("session_id"), F.col("token_id"))
    bare = keys.withColumn("own", _decrypted(F.col("wrapped"), old, place)).where("own is not null")
    return bare.select("session_id", "token_id", _encrypted(F.col("own"), new, place).alias("wrapped"))


def erase_keys(keys: DataFrame, erased: DataFrame) -> DataFrame:
    """Keys without those of the erased sessions (session_id): their boxes never open again."""
    return at_place(keys, erased.select("session_id").distinct(), "left_anti", ("session_id",))


def upsert(writes: DataFrame) -> DataFrame:
    """The last write of each (session_id, token_id), by created_at and then seq."""
    order = Window.partitionBy("session_id", "token_id").orderBy(F.desc("created_at"), F.desc("seq"))
    return writes.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def live(vault: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired: an entry goes once its time is strictly past."""
    return vault.where(F.col("expires_at").isNull() | ~(F.col("expires_at") < now))


def rehydrate(texts: DataFrame, vault: DataFrame, key: str, *, session: str = "session_id", text: str = "text", input_ids: str = "input_ids", output_ids: str = "output_ids", lenient: bool = False) -> DataFrame:
    """Texts with their tokens resolved from the session's vault: `final_text`, `unresolved` (ids, in
    order of appearance) and `review_required`.

    Where the texts have an array `input_ids`, only tokens minted for the input are opened; tokens in an array
    `output_ids`, minted by the output scan, always stay as they are, so that what a reply leaked is
    contained. Without `input_ids` the ids found in a text stand for it. `lenient` also opens input tokens whose form a reply
    changed, by their id inside any bracket. Only ids and values are shuffled until the last join."""
    hits, ids = (F.regexp_extract_all(F.col(text), F.lit(fixed.TOKEN), F.lit(i)) for i in (0, 1))
    none = F.expr("cast(array() as array<string>)")
    own = F.coalesce(F.col(input_ids), none) if input_ids in texts.columns else F.coalesce(ids, none)
    closed = F.coalesce(F.col(output_ids), none) if output_ids in texts.columns else none
    asked = texts.select(key, session, F.explode(F.array_distinct(F.array_except(own, closed))).alias("token_id"))
    found = asked.join(vault.select(session, "token_id", "value"), [session, "token_id"]).groupBy(key, "token_id").agg(F.min("value").alias("value"))
    listed = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token_id", "value"))).alias("values_"))
    joined = texts.join(listed, key, "left").withColumn("values_", F.coalesce("values_", F.expr("cast(map() as map<string,string>)")))

    def opened_(hit: Column, identity: Column) -> Column:
        value = F.element_at("values_", identity)
        return F.when(F.array_contains(closed, identity), hit).otherwise(F.coalesce(value, F.lit(fixed.UNRESOLVED)))

    parts = F.arrays_zip(F.split(F.col(text), fixed.TOKEN, -1).alias("gap"), F.zip_with(hits, ids, opened_).alias("new"))
    rebuilt = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "")
    final = F.when(F.size(hits) == 0, F.col(text)).otherwise(rebuilt)
    if lenient:
        session_.ship_package(texts.sparkSession)
        final = _reopened(final, F.map_keys("values_"), F.map_values("values_"))
    missing = F.when(F.col(text).isNotNull(), F.filter(ids, lambda i: ~F.array_contains(closed, i) & F.element_at("values_", i).isNull()))
    return joined.select(*texts.columns, final.alias("final_text"), missing.alias("unresolved"), (F.size(missing) > 0).alias("review_required"))


_BRACKETED, _ID = re.compile(r"[<\[(]([^<>\[\]()]*)[>\])]"), re.compile(r"(?=([0-9a-f]{10}))")


def reopened(text: str, values: dict[str, str]) -> str:
    """Brackets that hold a known id, whatever stands around it, replaced by its value: one pass over the text."""

    def value(match: re.Match) -> str:
        known = (values[m.group(1)] for m in _ID.finditer(match.group(1)) if m.group(1) in values)
        return next(known, match.group(0))

    return _BRACKETED.sub(value, text)


@F.arrow_udf(StringType())
def _reopened(texts: pa.Array, ids: pa.Array, values: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), ids.to_pylist(), values.to_pylist(), strict=True)
    return pa.array([t if not t or not i else reopened(t, dict(zip(i, v, strict=True))) for t, i, v in rows], pa.string())


def rehydrate_lenient(text: Column, token_id: Column, value: Column) -> Column:
    """A rewritten token, known by its id inside any bracket, replaced by its value."""
    pattern = F.concat(F.lit(r"[<\[(][^<>\[\]()]*"), token_id, F.lit(r"[^<>\[\]()]*[>\])]"))
    return F.regexp_replace(text, pattern, F.regexp_replace(value, r"([\\$])", r"\\$1"))
