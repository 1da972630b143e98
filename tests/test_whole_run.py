"""The whole run, its pieces against plain Python, and what the guard operators make of texts."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import expressions as E
from veilspan.functions import fixed
from veilspan.functions import text as T
from veilspan.operators import audit, detection, folds, guard, spans, vault
from veilspan.streaming import rehydrate

ANCHORED = [
    ("My e-mail is ann@x.org.", "EMAIL", "ann@x.org"), ("His cell number is 415-555-1234.", "PHONE", "415-555-1234"), ("Their ssn is 123-45-6789.", "GOV_ID", "123-45-6789"),
    ("Her credit card is 4111 1111 1111 1111.", "CREDIT_CARD", "4111 1111 1111 1111"), ("my name is Ann Lee.", "PERSON", "Ann Lee"), ("Our address is 5 High St.", "ADDRESS", "5 High St"),
    ("They live at 7 Low Rd; fine", "ADDRESS", "7 Low Rd"), ("the username is zed_9.", "USERNAME", "zed_9"), ("My birthday was March 3, 1990.", "DATE_TIME", "March 3, 1990"),
]


def test_all_nine_anchors(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(ANCHORED)], "id int, sentence string")
    got = {(r["id"], r["label"], r["text"]) for r in detection.locked_spans(rows, "sentence", ["id"]).collect()}
    assert {(i, label, value) for i, (_, label, value) in enumerate(ANCHORED)} <= got


@pytest.mark.parametrize("text", ["plain", "", "a​b", "x j o h n y", "Ａ①ª　ﬁ", "q w e r t y", "a b c"])
def test_folding_keeps_places(text):
    folded, places = T.folded_with_places(text)
    assert len(folded) == len(places) and places == sorted(set(places))
    assert all(f == text[p] or not text[p].isascii() for f, p in zip(folded, places, strict=True))


def test_folded_characters():
    assert T.folded_with_places("①ª　Ａﬁ")[0] == "1a Aﬁ"
    assert T.folded_with_places("go j o h n @ x")[0] == "go john@x"


def test_groups_are_placed_where_they_stand(spark):
    rows = spark.createDataFrame([("<name>name</name> <name> am </name>",)], "t string")
    got = detection.detect(rows, detection.named("tag_cue"), text="t").collect()
    assert [(s["start"], s["end"], s["text"]) for s in got] == [(6, 10, "name"), (25, 27, "am")]


def swept(found):
    """The resolution rule, span by span."""
    kept = []
    for start, end, label, confidence in sorted(found, key=lambda s: s[0]):
        if not kept or min(end, kept[-1][1]) - max(start, kept[-1][0]) <= 0:
            kept.append([start, end, label, confidence])
            continue
        prev = kept[-1]
        share = (min(end, prev[1]) - max(start, prev[0])) / min(end - start, prev[1] - prev[0])
        score = lambda s: s[3] + fixed.PRIORITY.get(s[2], 0) * 1e-4
        if label == prev[2]:
            kept[-1] = [min(start, prev[0]), max(end, prev[1]), label, max(confidence, prev[3])]
        elif share > 0.4:
            if score([start, end, label, confidence]) > score(prev):
                kept[-1] = [start, end, label, confidence]
        elif end > prev[1]:
            kept.append([prev[1], end, label, confidence])
    return [tuple(k) for k in kept]


def test_resolution_equals_the_sweep(spark):
    r = random.Random(3)
    units = []
    for u in range(60):
        starts = sorted(r.sample(range(60), r.randint(1, 8)))
        units.append((u, [(s, s + r.randint(1, 15), r.choice(["EMAIL", "PERSON", "ORG", "SECRET"]), r.choice([0.5, 0.7, 0.9])) for s in starts]))
    schema = "u int, s array<struct<start:int,end:int,label:string,confidence:double>>"
    rows = spark.createDataFrame(units, schema).withColumn("s", F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "label", "confidence")], F.lit("f").alias("format"), F.lit("r").alias("source"))))
    got = {x["u"]: [(k["start"], k["end"], k["label"], k["confidence"]) for k in x["r"]] for x in rows.select("u", spans.resolve(F.col("s")).alias("r")).collect()}
    assert got == {u: swept(found) for u, found in units}


def test_run_on_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "nothing here"), (4, "j o h n . d o e @ m a i l . c o m"), (5, "My email is not ann@x.org. " * 40), (6, "call 415-555-1234 now" + " pad" * 20000)], "id int, text string")
    got = {}
    for r in detection.run(rows, keep=["id"]).collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["text"], r["label"], r["negated"]))
    assert {1, 2, 3}.isdisjoint(got) and got[4][0][:2] == (0, 33) and got[4][0][3] == "EMAIL"
    assert len(got[5]) == 40 and all(s[4] and s[2] == "ann@x.org" for s in got[5])
    assert ("415-555-1234", "PHONE") in {s[2:4] for s in got[6]}


def test_tokens_of_equal_values_are_equal(spark):
    rows = spark.createDataFrame([("s", "Ａnn"), ("s", "Ann"), ("t", "Ann")], "session string, value string")
    ids = [r[0] for r in rows.select(E.token_id(F.col("session"), "k", F.col("value"))).collect()]
    assert ids[0] == ids[1] != ids[2]


def test_a_fold_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    import pyarrow as pa

    def step(state, n):
        state["sum"] = state.get("sum", 0) + n
        return (state["sum"],)

    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    got = folds.fold(rows, "k", ["n"], ["n"], dict, step, {"total": ("long", pa.int64())}).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert all(r["total"] == sum(range(r["k"], r["n"] + 1, 3)) for r in got) and len(got) == 100


def test_signed_records_are_not_linked_anew(spark):
    rows = audit.link(spark.createDataFrame([("c", 1, "a", None), ("c", 2, "b", "sig")], "chain string, seq long, body string, signature string"), "chain", "seq", "body")
    with pytest.raises(Exception, match="signed record"):
        audit.rechain(rows, "chain", "seq", "body").collect()
    again = audit.rechain(rows.drop("signature"), "chain", "seq", "body").collect()
    assert not any(r["changed"] for r in again)


def test_a_stream_keeps_output_tokens_closed():
    text = "a <EMAIL_PII_0123456789> b <EMAIL_PII_aaaaaaaaaa>"
    assert rehydrate.resolved(text, {"0123456789": "v", "aaaaaaaaaa": "leak"}, {"aaaaaaaaaa"}) == ("a v b <EMAIL_PII_aaaaaaaaaa>", 0)


def test_lenient_rehydration_and_containment(spark):
    rows = spark.createDataFrame([(1, "s", "see (PERSON PII 0123456789) and <X_PII_aaaaaaaaaa>", ["0123456789"], ["aaaaaaaaaa"])], "id int, session_id string, text string, input_ids array<string>, output_ids array<string>")
    stored = spark.createDataFrame([("s", "0123456789", "Ann"), ("s", "aaaaaaaaaa", "leak")], "session_id string, token_id string, value string")
    got = vault.rehydrate(rows, stored, "id", lenient=True).first()
    assert got["final_text"] == "see Ann and <X_PII_aaaaaaaaaa>" and got["unresolved"] == []


def test_sanitize_refuses_a_request_with_a_blocked_value(spark):
    rows = spark.createDataFrame([("r", 0, "s", "mail ann@x.org"), ("r", 1, "s", "card 4111 1111 1111 1111"), ("q", 0, "s", "hello"), ("p", 0, "s", None)], "request string, turn int, session string, text string")
    got = {(r["request"], r["turn"]): r for r in guard.sanitize(rows, "request", fixed.POLICIES["default"], session="session", secret="k").collect()}
    assert got[("r", 0)]["blocked"] == ["CREDIT_CARD"] and got[("r", 0)]["notice"] is None and "ann@x.org" not in got[("r", 0)]["sanitized"]
    assert got[("q", 0)]["sanitized"] == "hello" and got[("q", 0)]["blocked"] == [] and got[("p", 0)]["sanitized"] is None
