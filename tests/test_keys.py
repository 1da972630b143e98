"""Signatures and entry keys."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspan.functions import ed25519
from veilspan.functions import expressions as E
from veilspan.operators import audit, vault
from veilspan.plans import registry

# Test vectors of RFC 8032, section 7.1: seed, public key, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
     "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
     "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize(("seed", "public", "message", "signature"), VECTORS)
def test_signatures_of_the_standard(seed, public, message, signature):
    seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
    assert ed25519.public_key(seed) == public and ed25519.sign(message, seed) == signature
    assert ed25519.verified(message, signature, public)
    assert not ed25519.verified(message + b"x", signature, public)
    assert not ed25519.verified(message, signature[:-1] + bytes([signature[-1] ^ 1]), public)
    assert not ed25519.verified(message, signature, ed25519.public_key(b"\1" * 32)) and not ed25519.verified(message, b"", public)


def test_signatures_take_few_sums(monkeypatch):
    seed, sums, add = b"\3" * 32, [], ed25519._add
    public = ed25519.public_key(seed)
    assert ed25519.verified(b"0", ed25519.sign(b"0", seed), public)  # tables are made
    monkeypatch.setattr(ed25519, "_add", lambda a, b: sums.append(1) or add(a, b))
    assert all(ed25519.verified(m, ed25519.sign(m, seed), public) for m in (b"1", b"2", b"3"))
    assert len(sums) <= 3 * (64 + 2 * 64 + 1)


def test_no_other_encoding_is_a_signature():
    seed, message = b"\4" * 32, b"m"
    public, signature = ed25519.public_key(seed), ed25519.sign(message, seed)
    s = int.from_bytes(signature[32:], "little")
    assert not ed25519.verified(message, signature[:32] + (s + ed25519.ORDER).to_bytes(32, "little"), public)
    assert not ed25519.verified(message, signature[:31] + bytes([signature[31] ^ 128]) + signature[32:], public)
    for point in (b"\0" * 32, b"\xff" * 32, (ed25519.FIELD + 1).to_bytes(32, "little"), (1 | 1 << 255).to_bytes(32, "little")):
        assert not ed25519.verified(message, point + signature[32:], public) and not ed25519.verified(message, point + b"\0" * 32, public)
    assert not ed25519.verified(message, signature, b"\2" + b"\0" * 31) and not ed25519.verified(message, signature, b"\xff" * 32)


def test_signed_chains_are_verified_in_one_pass(spark):
    rows = spark.createDataFrame([("a", 0, "x")], "chain string, seq long, body string")
    signed = spark.createDataFrame([("a", "k", "00")], "chain string, key_id string, signature string")
    keys = spark.createDataFrame([("k", "00")], "key_id string, public_key string")
    found = audit.verify_signed(audit.link(rows, "chain", "seq", "body"), signed, keys, "chain", "seq", "body")
    assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    assert [tuple(r) for r in found.collect()] == [("a", 1, False, None, "invalid")]


def test_altered_records_are_found_by_their_heads(spark):
    rows = spark.createDataFrame([(c, i, f"{c}{i}") for c in ("a", "b", "c", "d") for i in range(4)] + [(None, 0, "n")], "chain string, seq long, body string")
    log = audit.link(rows, "chain", "seq", "body")
    seed = hashlib.sha256(b"k").digest()
    signed = audit.sign_heads(audit.heads(log, "chain", "seq").where("chain is null or chain <> 'c'"), "chain", seed, "k1").withColumn("signature", F.when(F.col("chain") == "d", "zz").otherwise(F.col("signature")))
    keys = spark.createDataFrame([("k1", ed25519.public_key(seed).hex())], "key_id string, public_key string")
    forged = audit.link(rows.withColumn("body", F.when((F.col("chain") == "b") & (F.col("seq") == 1), "other").otherwise(F.col("body"))), "chain", "seq", "body")
    assert all(r["ok"] for r in audit.verify(forged, "chain", "seq", "body").collect())  # the links alone do not tell
    got = {r["chain"]: (r["ok"], r["signature"]) for r in audit.verify_signed(forged, signed, keys, "chain", "seq", "body").collect()}
    assert got == {"a": (True, "valid"), "b": (False, "invalid"), "c": (False, "missing"), "d": (False, "invalid"), None: (True, "valid")}
    lax = {r["chain"]: r["ok"] for r in audit.verify_signed(forged, signed, keys, "chain", "seq", "body", require_signature=False).collect()}
    assert lax["c"] and not lax["b"]
    unknown = audit.verify_signed(log, signed, keys.where("false"), "chain", "seq", "body").where("chain = 'a'").first()
    assert (unknown["ok"], unknown["signature"]) == (False, "unknown key")


def test_entry_keys_do_not_follow_from_the_master_key(spark, tmp_path):
    entries = spark.createDataFrame([("s", str(i), f"välue {i}") for i in range(20)] + [("t", "0", "other"), ("t", "1", None)], "session_id string, token_id string, value string")
    master, new = (F.unhex(F.sha2(F.lit(k), 256)) for k in ("one", "two"))
    boxes, keys = vault.seal_entries(entries, master, str(tmp_path))
    opened = lambda k, m: {(r["session_id"], r["token_id"]): r["value"] for r in vault.open_entries(boxes, k, m).collect()}
    values = {(r["session_id"], r["token_id"]): r["value"] for r in entries.collect()}
    assert opened(keys, master) == values and set(opened(keys, new).values()) == {None}
    turned = vault.rewrap(keys, master, new)
    assert opened(turned, new) == values and set(opened(turned, master).values()) == {None}
    left = vault.erase_keys(turned, spark.createDataFrame([("s",)], "session_id string"))
    assert {k: v for k, v in opened(left, new).items() if v} == {("t", "0"): "other"}
    # With the keys gone, no key that the master key and a place could give opens a box.
    place = F.concat_ws(":", "session_id", "token_id")
    guesses = [master, F.unhex(F.sha2(F.concat(F.hex(master), F.lit(":entry:"), place), 256)), F.unhex(F.sha2(F.concat(F.hex(master), place), 256))]
    assert boxes.select(*[F.try_aes_decrypt("box", g, F.lit("GCM"), F.lit("DEFAULT"), place).alias(str(i)) for i, g in enumerate(guesses)]).where("session_id = 's'").distinct().collect() == [(None, None, None)]
    other = vault.seal_entries(entries, master, str(tmp_path / "again"))[1]
    assert not keys.join(other, "wrapped").count()


def test_values_are_folded_composed(spark):
    rows = spark.createDataFrame([("naïve",), ("naïve",), ("ﬁne",), (None,)], "v string")
    assert [r[0] for r in rows.select(E.nfkc(F.col("v"))).collect()] == ["naïve", "naïve", "fine", None]
    assert rows.limit(1).select(E.nfkc_array(F.array("v", F.lit("é"), F.lit(None)))).first()[0] == ["naïve", "é", None]


def test_entries_of_one_place_are_one_entry(spark, tmp_path):
    """A value that is stored again has the box and the key that it had: no box meets another's key."""
    rows = spark.createDataFrame([("s1", "t1", "a"), ("s1", "t1", "a"), ("s1", "t2", "b"), ("s2", "t1", "a"), ("s1", "t1", "a")], "session_id string, token_id string, value string")
    master = F.unhex(F.sha2(F.lit("m"), 256))
    boxes, keys = vault.seal_entries(rows, master, str(tmp_path / "twice"))
    assert boxes.count() == keys.count() == 3
    assert sorted(tuple(r) for r in vault.open_entries(boxes, keys, master).collect()) == [("s1", "t1", "a"), ("s1", "t2", "b"), ("s2", "t1", "a")]


# The first two names have one token in nation 1 (852d2dd8ce), the next two are one when folded; nation 27 is in no table of nations.
CUSTOMERS = [("Customer#000043813", 1), ("Customer#000977844", 1), ("Customer#1", 2), ("Ｃustomer#1", 2), ("Customer#1", 2), ("", 4), ("Müller", 27), ("Meier", -3), ("Ann", 3), ("Bob", None), (None, 5), (None, 6), (None, None)]


@pytest.mark.parametrize("name", ["vault_crypto_erase", "vault_entry_keys", "vault_key_rotation"])
def test_every_customer_has_an_entry_of_its_own(spark, tmp_path, name):
    rows = [(i, *c) for i, c in enumerate(CUSTOMERS)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i,) for i in range(25)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    wanted = duckdb.connect().execute(registry.oracle_sql()[name].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str) and len(got) == len(CUSTOMERS)


def test_values_of_one_token_are_parted(spark, tmp_path):
    """Equal values stay one entry; a place without a session or a token opens too."""
    made = [("s", "t", "b"), ("s", "t", "a"), ("s", "t", "b"), ("r", "t", "b"), (None, "t", "c"), ("s", None, "d"), (None, None, "e"), (None, None, None)]
    entries = vault.parted(spark.createDataFrame(made, "session_id string, token_id string, value string"))
    assert sorted(map(str, entries.collect())) == sorted(str(r) for r in spark.createDataFrame([("s", "t~1", "b"), ("s", "t", "a"), ("s", "t~1", "b"), ("r", "t", "b"), (None, "t", "c"), ("s", None, "d"), (None, "~1", "e"), (None, None, None)], entries.schema).collect())
    master = F.unhex(F.sha2(F.lit("m"), 256))
    boxes, keys = vault.seal_entries(entries, master, str(tmp_path / "parted"))
    assert sorted(r["value"] or "-" for r in vault.open_entries(boxes, keys, master).collect()) == ["-", "a", "b", "b", "c", "d", "e"]
    left = vault.erase_keys(keys, spark.createDataFrame([(None,)], "session_id string"))
    assert sorted(r["value"] or "-" for r in vault.open_entries(boxes, left, master).collect()) == ["-", "-", "-", "a", "b", "b", "d"]


def test_every_chain_is_signed_and_verified(spark, tmp_path):
    """All users' chains, also those of one record (which is cut off in chain 42), of negative users and of none."""
    users = [*range(40), *range(0, 40, 3), *range(40), -3, -3, None, None]
    spark.createDataFrame([(i, u, "view") for i, u in enumerate(users)] + [(1000, 42, "view")], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    wanted = duckdb.connect().execute(registry.oracle_sql()["audit_signed"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in registry.queries()["audit_signed"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str) and len(got) == 43 and (42, 0, False, "invalid") in got


def test_chains_that_are_gone_are_invalid(spark):
    log = audit.link(spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "chain string, seq long, body string"), "chain", "seq", "body")
    seed = hashlib.sha256(b"k").digest()
    signed = audit.sign_heads(audit.heads(log, "chain", "seq"), "chain", seed, "k1")
    keys = spark.createDataFrame([("k1", ed25519.public_key(seed).hex())], "key_id string, public_key string")
    got = audit.verify_signed(log.where("chain = 'a'"), signed, keys, "chain", "seq", "body", require_signature=False).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, True, None, "valid"), ("b", 0, False, None, "invalid")]
