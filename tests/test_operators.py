"""Span algebra, policy, vault, limits, audit, sources and streaming on small tables."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspan.functions import fixed
from veilspan.operators import audit, detection, policy, routing, spans, vault
from veilspan.sources import chat, files
from veilspan.streaming import rehydrate

SPANS = "id int, ord int, start int, end int, label string, confidence double, text string"


def test_gap_merge_and_resolution(spark):
    text = "call Ann Lee, now 12345 678"
    rows = [(1, 0, 5, 8, "PERSON", 0.6, text), (1, 1, 9, 12, "PERSON", 0.8, text), (1, 2, 5, 12, "ORG", 0.7, text), (1, 3, 18, 21, "PHONE", 0.9, text)]
    got = {(r["label"], r["start"], r["end"]) for r in spans.repair(spark.createDataFrame(rows, SPANS), "id", "text").collect()}
    assert ("PHONE", 18, 27) in got
    assert len([g for g in got if g[1] < 13]) == 1


def test_splice_skips_overlapping_edits(spark):
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("new")) for a, b, n in ((0, 3, "X"), (2, 5, "Y"), (6, 7, "Z"))])
    assert spark.range(1).select(spans.splice(F.lit("abcdefgh"), edits)).first()[0] == "XdefZh"


def test_policy_truth_table(spark):
    rows = [("SECRET", 0.9, False), ("PERSON", 0.4, False), ("PERSON", 0.9, False), ("EMAIL", 0.9, True), ("OTHER", 0.9, False)]
    made = spark.createDataFrame([(*r, 0, 30) for r in rows], "label string, confidence double, negated boolean, start int, end int")
    rules = policy.rules_table(spark, {"default": fixed.POLICIES["default"]})
    got = {(r["label"], r["confidence"]): (r["action"], r["rule_id"], r["compressible"]) for r in policy.evaluate(made, rules).collect()}
    assert got[("SECRET", 0.9)] == ("BLOCK", "SECRET", False)
    assert got[("PERSON", 0.4)] == ("PRESERVE", "PERSON:below_min_confidence", True)
    assert got[("PERSON", 0.9)] == ("REVERSIBLE", "PERSON", False)
    assert got[("EMAIL", 0.9)] == ("PRESERVE", "locked_span_negation", True)
    assert got[("OTHER", 0.9)] == ("PRESERVE", "OTHER:default_preserve", True)


@pytest.mark.parametrize("rules", [{"NOPE": ("BLOCK", None, None)}, {"EMAIL": ("EAT", None, None)}, {"EMAIL": ("BLOCK", 1.5, None)}])
def test_bad_policies_are_refused(rules):
    with pytest.raises(ValueError):
        policy.validate(rules)


def test_planted_values_never_survive(spark):
    random.seed(5)
    planted = [f"{random.randint(100, 899)}-{random.randint(10, 99)}-{random.randint(1000, 9999)}" for _ in range(24)]
    rows = spark.createDataFrame([(i, f"My number: {v}, thanks.") for i, v in enumerate(planted)], "id int, text string")
    found = detection.detect(rows, detection.FAMILIES, keep=["id"])
    decided = policy.evaluate(found, policy.rules_table(spark, {"default": fixed.POLICIES["default"]}))
    minted = vault.mint(decided.withColumn("session_id", F.lit("s")), "session_id", "k")
    edits = minted.groupBy("id").agg(F.collect_list(F.struct("start", "end", F.col("token").alias("new"))).alias("edits"))
    for r in rows.join(edits, "id").select("id", spans.splice(F.col("text"), F.col("edits")).alias("out")).collect():
        assert planted[r["id"]] not in r["out"]


def test_rehydration(spark):
    texts = spark.createDataFrame([(1, "s", "a <EMAIL_PII_0123456789> b <X_PII_aaaaaaaaaa>"), (2, "s", "plain"), (3, "s", None)], "id int, session_id string, text string")
    stored = spark.createDataFrame([("s", "0123456789", "x@y.z")], "session_id string, token_id string, value string")
    got = {r["id"]: (r["final_text"], r["unresolved"]) for r in vault.rehydrate(texts, stored, "id").collect()}
    assert got[1] == ("a x@y.z b [UNRESOLVED_PII_TOKEN]", ["aaaaaaaaaa"])
    assert got[2][0] == "plain"


def test_audit_detects_tampering(spark):
    rows = spark.createDataFrame([("c", i, f"body{i}") for i in range(5)], "chain string, seq long, body string")
    linked = audit.link(rows, "chain", "seq", "body")
    assert audit.verify(linked, "chain", "seq", "body").first()["ok"]
    changed = linked.withColumn("body", F.when(F.col("seq") == 3, "other").otherwise(F.col("body")))
    bad = audit.verify(changed, "chain", "seq", "body").first()
    assert (bad["ok"], bad["first_bad"]) == (False, 3)
    assert audit.evidence(linked.where("false"), "chain", "seq", "body").first()["chain_verified"]


def test_canonical_omits_or_marks_nulls(spark):
    rows = spark.createDataFrame([("x", None)], "a string, b string")
    assert rows.select(audit.canonical(["a", "b"])).first()[0] == "a=1:x|b=-"
    assert rows.select(audit.canonical(["a", "b"], omit_null=("b",))).first()[0] == "a=1:x"


def test_gemini_instruction_and_unknown_payload(spark):
    rows = spark.createDataFrame([(1, '{"systemInstruction":{"parts":[{"text":"be"},{"text":"kind"}]},"contents":[{"parts":[{"text":"hi"}]}]}'), (2, "{}")], "id int, payload string")
    got = [(r["id"], r["role"], r["content"]) for r in chat.messages(rows, "id").orderBy("id", "turn_index").collect()]
    assert got == [(1, "system", "be kind"), (1, "user", "hi")]


def test_office_files(spark):
    def archive(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    word = archive({"word/document.xml": '<w:d xmlns:w="w"><w:p><w:t>Hello</w:t></w:p><w:p/></w:d>'})
    sheet = archive({"xl/sharedStrings.xml": '<s xmlns="x"><si><t>name</t></si></s>', "xl/worksheets/sheet1.xml": '<w xmlns="x"><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'})
    rows = spark.createDataFrame([("a.docx", bytearray(word)), ("b.xlsx", bytearray(sheet)), ("c.pdf", bytearray(b"%PDF"))], "path string, content binary")
    got = {r["file"]: (r["text"], r["error"] is None) for r in files.office_units(rows).collect()}
    assert got == {"a.docx": ("Hello", True), "b.xlsx": ("name\t7", True), "c.pdf": (None, False)}


@pytest.mark.parametrize("size", [1, 3, 28])
def test_held_back_tail_never_splits_a_token(size):
    text = "1 < 2 <EMAIL_PII_0123456789> and <<X_PII_0123456789> < end <"
    tail, out = "", []
    for at in range(0, len(text), size):
        tail += text[at : at + size]
        cut = len(tail) if at + size >= len(text) else rehydrate.held_from(tail)
        assert len(tail) - cut < fixed.TOKEN_LENGTH
        out.append(rehydrate.resolved(tail[:cut], {"0123456789": "v"})[0])
        tail = tail[cut:]
    assert "".join(out) == rehydrate.resolved(text, {"0123456789": "v"})[0]
