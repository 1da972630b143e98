"""Column expressions: checksums, keyed hashes, folded values, tokens."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from veilspan import session as package
from veilspan.functions import fixed


def digits(column: Column) -> Column:
    return F.regexp_replace(column, r"\D", "")


def digit_array(column: Column) -> Column:
    return F.transform(F.split(column, ""), lambda c: c.try_cast("int"))


def saudi_checksum(number: Column) -> Column:
    """Ten digits led by 1 or 2: doubling from the first digit, total divisible by ten."""
    doubled = F.transform(digit_array(number), lambda d, i: F.when(i % 2 == 0, F.when(d * 2 < 10, d * 2).otherwise(d * 2 - 9)).otherwise(d))
    return number.rlike("^[12][0-9]{9}$") & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def kuwait_checksum(number: Column) -> Column:
    """Twelve digits: eleven minus the weighted sum modulo eleven is the last digit."""
    weights = F.array(*[F.lit(w) for w in fixed.KUWAIT_WEIGHTS])
    products = F.zip_with(F.slice(digit_array(number), 1, 11), weights, lambda d, w: d * w)
    expected = 11 - F.aggregate(products, F.lit(0), lambda a, d: a + d) % 11
    return number.rlike("^[0-9]{12}$") & (expected < 10) & (expected == F.substring(number, 12, 1).try_cast("int"))


def uae_checksum(number: Column) -> Column:
    """Fifteen digits: Luhn's rule on the first fourteen; null where the shape is another."""
    doubled = F.transform(F.reverse(F.slice(digit_array(number), 1, 14)), lambda d, i: F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(number.rlike("^[0-9]{15}$"), (total * 9) % 10 == F.substring(number, 15, 1).try_cast("int"))


def _padded(key_hex: Column, byte: int) -> Column:
    """The 64-byte block of a key of up to 32 bytes, XORed with one repeated byte: eight bytes at a time as a number."""
    own, mask = F.rpad(key_hex, 64, "0"), int.from_bytes(bytes([byte]) * 8)
    words = [F.conv(F.substring(own, at, 16), 16, -10).cast("long").bitwiseXOR(F.lit(mask)) for at in (1, 17, 33, 49)]
    return F.unhex(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words], F.lit(f"{byte:02x}" * 32)))


def hmac_sha256(key_hex: Column, message: Column) -> Column:
    """HMAC-SHA256 of a text under a 32-byte key given in hex, as hex."""
    inner = F.sha2(F.concat(_padded(key_hex, 0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(_padded(key_hex, 0x5C), F.unhex(inner)), 256)


def session_key(session: Column, secret: str) -> Column:
    return F.sha2(F.concat_ws(":", session, F.lit(secret)), 256)


def token_id(session: Column, secret: str, value: Column) -> Column:
    """First ten hex digits of the keyed hash of the value, which is folded first (NFKC), so that forms of
    one value have one token. Values of ASCII alone are their own folded form and stay in the JVM."""
    return F.substring(hmac_sha256(session_key(session, secret), nfkc(value)), 1, 10)


def folded(value: str | None) -> str | None:
    """Python's own folding: Arrow's leaves characters decomposed."""
    return value and unicodedata.normalize("NFKC", value)


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([folded(v) for v in values.to_pylist()], pa.string())


def nfkc(value: Column) -> Column:
    package.ship_package(SparkSession.active())
    return F.coalesce(_nfkc(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value)


@F.arrow_udf(ArrayType(StringType()))
def _nfkc_array(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else [folded(x) for x in v] for v in values.to_pylist()], pa.list_(pa.string()))


def nfkc_array(values: Column) -> Column:
    """Each value folded (NFKC); arrays of ASCII alone stay in the JVM."""
    package.ship_package(SparkSession.active())
    return F.coalesce(_nfkc_array(F.when(F.exists(values, lambda v: v.rlike(r"[^\x00-\x7F]")), values)), values)


def token(label: Column, identity: Column) -> Column:
    return F.concat(F.lit("<"), label, F.lit("_PII_"), identity, F.lit(">"))
