"""Queries over texts with planted values, whose results SQL can state: the whole run, families, repair, sentences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed, text
from veilspan.operators import detection, guard, policy, routing, spans, stored
from veilspan.plans import governance
from veilspan.plans.detection import _LUHN_SQL
from veilspan.session import shared_folder, table
from veilspan.sources import files

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/planted-{uuid.uuid4().hex}"


def _said(spark: SparkSession, sf: str, said: str, name: str = "customer", *keep: str) -> DataFrame:
    """The table's key and a text, by an expression that both engines read."""
    return table(spark, sf, name).select(*(keep or ("c_custkey",)), F.expr(said).alias("text"))


_DIGITS = "'4' || lpad(CAST(c_custkey AS VARCHAR(12)), 14, '0') || CAST(c_custkey % 10 AS VARCHAR(2))"
_CARD = f"CASE WHEN c_custkey % 3 = 0 THEN substr({_DIGITS}, 1, 4) || '-' || substr({_DIGITS}, 5, 4) || '-' || substr({_DIGITS}, 9, 4) || ' ' || substr({_DIGITS}, 13, 4) ELSE {_DIGITS} END"


@query("detect_card_luhn", f"SELECT c_custkey, hit, 0.99::DOUBLE AS confidence FROM (SELECT c_custkey, {_CARD} AS hit, {_DIGITS} AS d FROM customer) WHERE {_LUHN_SQL}")
def detect_card_luhn(spark: SparkSession, sf: str) -> DataFrame:
    """Card numbers with and without separators; those whose check digit is wrong are none."""
    found = detection.detect(_said(spark, sf, f"'pay ' || {_CARD} || ' now'"), detection.named("card"), keep=["c_custkey"])
    return found.select("c_custkey", F.col("text").alias("hit"), "confidence")


_ABROAD = "CASE c_custkey % 3 WHEN 0 THEN '+44 7911 ' || lpad(CAST(c_custkey % 1000000 AS VARCHAR(12)), 6, '1') WHEN 1 THEN '+971 (4) 12 34 ' || lpad(CAST(c_custkey % 100 AS VARCHAR(12)), 2, '0') ELSE '+7-12' END"


@query("detect_phone_international", f"SELECT c_custkey, {_ABROAD} AS hit FROM customer WHERE c_custkey % 3 < 2")
def detect_phone_international(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with a country code; too few digits make none."""
    found = detection.detect(_said(spark, sf, f"'call ' || {_ABROAD} || ' or so'"), detection.named("phone", "intl"), keep=["c_custkey"])
    return found.select("c_custkey", F.col("text").alias("hit"))


_LETTER = "substr('abcdefghijklmnopqrstuvwxyz', CAST(c_custkey % 26 AS INT) + 1, 1)"


@query(
    "detect_names",
    f"SELECT c_custkey, 'name_cue' AS format, 'Bo' || {_LETTER} AS hit, 0.88::DOUBLE AS confidence FROM customer UNION ALL SELECT c_custkey, 'capword_seq', 'Ann Le' || {_LETTER}, 0.55 FROM customer",
)
def detect_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names after a cue, and capitalized words within a sentence; a field's label and an organisation are no names."""
    said = f"'We met Ann Le' || {_LETTER} || ' and my name is Bo' || {_LETTER} || '. Then Home Town : x and Acme Labs Inc. too'"
    found = detection.detect(_said(spark, sf, said), detection.named("name_cue", "capword_seq"), keep=["c_custkey"])
    return found.select("c_custkey", "format", F.col("text").alias("hit"), "confidence")


@query("detect_streets", f"SELECT c_custkey, (c_custkey % 900 + 1) || ' Oak Street, Spring' || {_LETTER} AS hit FROM customer")
def detect_streets(spark: SparkSession, sf: str) -> DataFrame:
    said = f"'he lives at ' || CAST(c_custkey % 900 + 1 AS VARCHAR(9)) || ' Oak Street, Spring' || {_LETTER} || ' now'"
    return detection.detect(_said(spark, sf, said), detection.named("street_pattern"), keep=["c_custkey"]).select("c_custkey", F.col("text").alias("hit"))


@query("detect_packs", "SELECT c_custkey, p AS packs, CASE WHEN p = 'base_en' THEN 0 ELSE 1 END::BIGINT AS ids, 1::BIGINT AS mails FROM customer, (VALUES ('base_en'), ('base_en,gulf_ar')) v(p)")
def detect_packs(spark: SparkSession, sf: str) -> DataFrame:
    """A policy's packs switch families on: a bare eight-digit number is an identity number in one of them only."""
    rows = _said(spark, sf, "'no ' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 8, '4') || ' of c' || CAST(c_custkey AS VARCHAR(12)) || '@mail.com'")
    out = None
    for packs in (("base_en",), ("base_en", "gulf_ar")):
        found = rows.withColumn("found", detection.found_of("text", packs, ner=False))
        count = lambda label: F.size(F.filter("found", lambda s: s["label"] == label)).cast("long")
        own = found.select("c_custkey", F.lit(",".join(packs)).alias("packs"), count("GOV_ID").alias("ids"), count("EMAIL").alias("mails"))
        out = own if out is None else out.unionByName(own)
    return out


_WHOLE = "'Mail c' || c_custkey || '@mail.com, pay 4111 1111 1111 1111 from 10.' || (c_custkey % 200) || '.3.4. My email is not a' || c_custkey || '@x.org. Our phone number is 415-555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0') || '; bye'"
_PLANTED = (
    ("EMAIL", "'c' || c_custkey || '@mail.com'", "regex", 0.98, False), ("CREDIT_CARD", "'4111 1111 1111 1111'", "regex", 0.99, False), ("IP_ADDRESS", "'10.' || (c_custkey % 200) || '.3.4'", "regex", 0.9, False),
    ("EMAIL", "'a' || c_custkey || '@x.org'", "locked", 0.9, True), ("PHONE", "'415-555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0')", "locked", 0.95, False),
)


@query(
    "whole_run_planted",
    " UNION ALL ".join(
        f"SELECT c_custkey, (strpos({_WHOLE}, {hit}) - 1)::INT AS start, (strpos({_WHOLE}, {hit}) - 1 + len({hit}))::INT AS \"end\", {hit} AS hit, '{label}' AS label, '{source}' AS source, {confidence}::DOUBLE AS confidence, {negated} AS negated FROM customer"
        for label, hit, source, confidence, negated in _PLANTED
    ),
)
def whole_run_planted(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run with every family: a mail, a card, an address, and two values that ownership anchors lock."""
    found = detection.run(_said(spark, sf, _WHOLE), keep=["c_custkey"])
    return found.select("c_custkey", "start", "end", F.col("text").alias("hit"), "label", "source", "confidence", "negated")


_STRICT = "'Card of ' || c_name || ': write to c' || c_custkey || '@mail.com or 10.1.' || c_nationkey || '.' || (c_custkey % 200)"


@query(
    "output_scan_strict",
    f"SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace({_STRICT}, '{fixed.EMAIL}', '<EMAIL>', 'g'), '{fixed.IPV4}', '[REDACTED_OUTPUT_IP_ADDRESS]', 'g'), '(^|\\D)\\d{{9}}(\\D|$)', '\\1[REDACTED_OUTPUT_GOV_ID]\\2', 'g') AS shown FROM customer",
)
def output_scan_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The strict policy on a reply with every family but the entity ones: nine bare digits are an identity number."""
    rows = _said(spark, sf, _STRICT).withColumn("session_id", F.lit("s"))
    done = guard.scan_output(rows, fixed.POLICIES["finance_strict"], session="session_id", secret=governance.SECRET, ner=False)
    return done.select("c_custkey", F.regexp_replace("shown", r"<([A-Z_]+)_PII_[0-9a-f]{10}>", "<$1>").alias("shown"))


@query("span_repaired", "SELECT c_custkey, 'PHONE' AS label, 4::INT AS start, 16::INT AS \"end\", 0.9::DOUBLE AS confidence FROM customer UNION ALL SELECT c_custkey, 'PERSON', 20, 30, 0.8 FROM customer")
def span_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """A number cut short grows over its last digit; a name cut at its front snaps to the word and joins its neighbour."""
    rows = _said(spark, sf, "'tel 415-555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0') || ' of Mary Jones'")
    made = [(0, 4, 15, "PHONE", 0.9), (1, 21, 24, "PERSON", 0.7), (2, 25, 30, "PERSON", 0.8)]
    listed = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("ord", "start", "end", "label", "confidence"), m, strict=True)]) for m in made])).alias("s")
    return spans.repair(rows.select("c_custkey", "text", listed).select("c_custkey", "text", "s.*"), "c_custkey", "text").select("c_custkey", "label", "start", "end", "confidence")


_RANKED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.PRIORITY.items())


@query(
    "span_resolved_pairs",
    f"""WITH s AS (SELECT o_custkey AS unit, o_orderkey AS ord, (o_orderkey % 40)::INT AS start, (o_orderkey % 40 + 4 + o_orderkey % 9)::INT AS e,
      CASE WHEN o_orderkey % 3 = 0 THEN 'EMAIL' WHEN o_orderkey % 3 = 1 THEN 'PERSON' ELSE 'ORG' END AS label, 0.5 + (o_orderkey % 5) / 10.0 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY start, ord) AS k FROM s WHERE i <= 2),
    j AS (SELECT a.unit, a.start AS s1, a.e AS e1, a.label AS l1, a.c + CASE a.label {_RANKED} END * 1e-4 AS r1, b.start AS s2, b.e AS e2, b.label AS l2, b.c + CASE b.label {_RANKED} END * 1e-4 AS r2,
      least(a.e, b.e) - b.start AS o, least(a.e - a.start, b.e - b.start) AS shorter FROM p a LEFT JOIN p b ON a.unit = b.unit AND b.k = 2 WHERE a.k = 1),
    r AS (SELECT *, CASE WHEN s2 IS NULL THEN 'one' WHEN o <= 0 THEN 'both' WHEN l1 = l2 THEN 'united' WHEN o / shorter > 0.4 THEN 'better' WHEN e2 > e1 THEN 'trimmed' ELSE 'one' END AS rule FROM j)
    SELECT unit, CASE WHEN rule = 'better' AND r2 > r1 THEN s2 ELSE s1 END AS start, CASE WHEN rule = 'united' THEN greatest(e1, e2) WHEN rule = 'better' AND r2 > r1 THEN e2 ELSE e1 END AS "end",
      CASE WHEN rule = 'better' AND r2 > r1 THEN l2 ELSE l1 END AS label, CASE WHEN rule = 'united' THEN 'united' ELSE 'kept' END AS how FROM r
    UNION ALL SELECT unit, CASE WHEN rule = 'trimmed' THEN e1 ELSE s2 END, e2, l2, CASE WHEN rule = 'trimmed' THEN 'trimmed' ELSE 'kept' END FROM r WHERE rule IN ('both', 'trimmed')""",
)
def span_resolved_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two spans of a unit: apart, of one label, overlapping much, or little."""
    n = F.col("o_orderkey")
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf, "orders").withColumn("i", i).where("i <= 2")
    label = F.when(n % 3 == 0, "EMAIL").when(n % 3 == 1, "PERSON").otherwise("ORG")
    none = F.lit(None).cast("string")
    one = F.struct((n % 40).cast("int").alias("start"), n.alias("ord"), (n % 40 + 4 + n % 9).cast("int").alias("end"), label.alias("label"), (F.lit(0.5) + n % 5 / 10).alias("confidence"), none.alias("format"), none.alias("source"))
    listed = rows.groupBy(F.col("o_custkey").alias("unit")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    return listed.select("unit", F.explode(spans.resolve(F.col("s"))).alias("r")).select("unit", "r.start", "r.end", "r.label", "r.how")


@query(
    "sentences_of_names",
    "SELECT c_custkey, i::INT AS idx, CASE i WHEN 0 THEN 'Dr. ' || c_name || ' met us, e.g. here. ' WHEN 1 THEN 'They \"left!\" ' ELSE 'Ok ' || c_custkey END AS sentence FROM customer, (VALUES (0), (1), (2)) v(i)",
)
def sentences_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences end at marks with closing quotes, not after known abbreviations; the white space after belongs to them."""
    rows = _said(spark, sf, "'Dr. ' || c_name || ' met us, e.g. here. They \"left!\" Ok ' || c_custkey")
    return text.sentences(rows, keep=("c_custkey",)).select("c_custkey", "idx", "sentence")


_TOKENS = "'Ask <PERSON_PII_' || substr({}, 1, 10) || '> of ' || c_name || ' <EMAIL_PII_0123456789>'"


@query("tokens_stripped", f"SELECT c_custkey, regexp_replace({_TOKENS.format('sha256(c_name)')}, '{fixed.TOKEN}', 'REDACTED', 'g') AS clean FROM customer")
def tokens_stripped(spark: SparkSession, sf: str) -> DataFrame:
    return _said(spark, sf, _TOKENS.format("sha2(c_name, 256)")).select("c_custkey", routing.strip_tokens(F.col("text")).alias("clean"))


@query("text_files", "SELECT n_nationkey AS file, 'document' AS location, n_name || chr(10) || ' of ' || n_regionkey || chr(10) AS text FROM nation")
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each text file is one unit, line ends and all."""
    path = _folder(spark)
    rows = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n of "), F.col("n_regionkey").cast("string")).alias("value"))
    rows.write.partitionBy("n_nationkey").text(path)
    return files.whole_texts(spark, f"{path}/*").select(F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("long").alias("file"), "location", "text")


@query(
    "enrollment_outcomes",
    """WITH t AS (SELECT c_custkey AS token, TIMESTAMP '2024-01-10' + (c_custkey % 20) * INTERVAL 1 DAY AS expires FROM customer WHERE c_custkey % 4 <> 0),
    u AS (SELECT event_id, user_id AS token, ts, t.token IS NOT NULL AS known, ts <= expires AS valid FROM events LEFT JOIN t ON t.token = user_id),
    v AS (SELECT *, row_number() OVER (PARTITION BY token, known AND valid ORDER BY ts, event_id) AS place FROM u)
    SELECT event_id, CASE WHEN NOT known THEN 'unknown' WHEN NOT valid THEN 'expired' WHEN place > 1 THEN 'used' ELSE 'enrolled' END AS outcome FROM v""",
)
def enrollment_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """One-time tokens: unknown ones, expired ones, those that an earlier use took, and the one use that enrolls."""
    expires = F.expr("timestamp'2024-01-10 00:00:00' + make_dt_interval(cast(c_custkey % 20 as int))").alias("expires")
    tokens = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("token"), expires)
    uses = table(spark, sf, "events").select("event_id", F.col("user_id").alias("token"), F.to_timestamp("ts").alias("at"))
    return routing.enrolled(uses, tokens, "token", ["at", "event_id"]).select("event_id", "outcome")


@query(
    "verdict_label_counts",
    f"""WITH {governance._FOUND}, c AS (SELECT doc_id, label, count(*) AS n FROM found GROUP BY ALL)
    SELECT doc_id, string_agg(label || '=' || n, ',' ORDER BY label) AS labels FROM c GROUP BY doc_id""",
)
def verdict_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The number of spans of each label that a unit's verdict reports."""
    counted = policy.label_counts(governance._decided(spark, sf), "doc_id")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return counted.select("doc_id", shown.alias("labels"))


@query("stream_dedupe_exact", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedupe_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Records delivered again at any later time: a history of stored ids drops them, where a watermark would have forgotten."""
    rows, path = table(spark, sf, "events").select("event_id", "event_type"), _folder(spark)
    rows.where("event_id % 2 = 0").write.parquet(f"{path}/in")
    for _ in range(2):
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        stored.ingest(stream, f"{path}/kept", ["event_id"], f"{path}/checkpoint").awaitTermination()
    return stored.stored(spark, f"{path}/kept", "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_compatibility", "SELECT c_custkey, c_name || ' ﬁ a' AS clean, len(c_name)::BIGINT + 4 AS kept FROM customer")
def normalize_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """Characters whose compatibility form is one character are folded one for one; a ligature, which is two, stays."""
    wide = F.concat(F.translate("c_name", "123456789", "①②③④⑤⑥⑦⑧⑨"), F.lit(" ﬁ ª"))
    rows = table(spark, sf, "customer").select("c_custkey", wide.alias("text"))
    return rows.select("c_custkey", text.normalize(F.col("text")).alias("clean"), F.size(text.offset_map(F.col("text"))).cast("long").alias("kept"))


_CUED = "'passport number AB' || lpad(CAST(c_custkey % 10000000 AS VARCHAR(12)), 7, '2') || ', username is zed_' || c_custkey || ', born March ' || (c_custkey % 28 + 1) || ', 19' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0') || ' or 3rd march 19' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0') || '; code CD1234567'"


@query(
    "detect_cued",
    "SELECT c_custkey, 'alnum-id-cued' AS format, 'AB' || lpad(CAST(c_custkey % 10000000 AS VARCHAR(12)), 7, '2') AS hit FROM customer UNION ALL SELECT c_custkey, 'cued', 'zed_' || c_custkey FROM customer UNION ALL SELECT c_custkey, 'date-month-first', 'March ' || (c_custkey % 28 + 1) || ', 19' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0') FROM customer UNION ALL SELECT c_custkey, 'date-day-first', '3rd march 19' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0') FROM customer",
)
def detect_cued(spark: SparkSession, sf: str) -> DataFrame:
    """Identity numbers and user names after their cues, dates with month names; a code without a cue is none."""
    families = detection.named("alnum-id-cued", "cued", "date-month-first", "date-day-first")
    return detection.detect(_said(spark, sf, _CUED), families, keep=["c_custkey"]).select("c_custkey", "format", F.col("text").alias("hit"))


_NINE = "lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR(12)), 9, '0')"
_GULF = f"CASE c_custkey % 7 WHEN 0 THEN '784-1990-' || substr({_NINE}, 3, 7) || '-5' WHEN 1 THEN '2' || {_NINE} WHEN 2 THEN '1' || {_NINE} WHEN 3 THEN '3' || {_NINE} || '4' WHEN 4 THEN '8811' || substr({_NINE}, 5, 5) WHEN 5 THEN '2' || {_NINE} || '07' ELSE '9' || substr({_NINE}, 3, 7) END"


@query(
    "gulf_id_types",
    f"SELECT c_custkey, ['uae_emirates_id', 'sa_iqama', 'sa_national_id', 'qa_qid', 'bh_cpr', 'kw_civil_id', 'om_civil_number'][c_custkey % 7 + 1] AS id_type, {_GULF} AS hit FROM customer",
)
def gulf_id_types(spark: SparkSession, sf: str) -> DataFrame:
    """Each of the seven types of identity numbers, told by its shape."""
    gulf = [f for f in detection.FAMILIES if f.pack == "gulf_ar"]
    found = detection.detect(_said(spark, sf, f"'no ' || {_GULF} || ' of it'"), gulf, keep=["c_custkey"])
    return found.select("c_custkey", F.col("format").alias("id_type"), F.col("text").alias("hit"))


@query(
    "sanitized_values",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CREDIT_CARD' ELSE '' END AS blocked,
      'Host <IP_ADDRESS> of <EMAIL>, ' || CASE WHEN c_custkey % 5 = 0 THEN '<CREDIT_CARD>' ELSE 'call <PHONE>' END || '; ok' AS shown, 3::BIGINT AS minted FROM customer""",
)
def sanitized_values(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with an address, a mail, and a card or a phone number: tokens (shown by their label), and what is refused."""
    said = "'Host 10.2.' || (c_custkey % 250) || '.4 of c' || c_custkey || '@mail.com, ' || CASE WHEN c_custkey % 5 = 0 THEN '4111 1111 1111 1111' ELSE 'call 415-555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR(9)), 2, '0') END || '; ok'"
    rows = _said(spark, sf, said).withColumn("session", F.lit("s"))
    done = guard.sanitize(rows, "c_custkey", fixed.POLICIES["default"], session="session", secret=governance.SECRET)
    shown = F.regexp_replace("sanitized", r"<([A-Z_]+)_PII_[0-9a-f]{10}>", "<$1>")
    return done.select("c_custkey", F.array_join("blocked", ",").alias("blocked"), shown.alias("shown"), F.col("minted").cast("long").alias("minted"))


@query(
    "tool_values",
    """SELECT c_custkey, 'rewritten' AS outcome, 'ask [TOKEN] at [TOKEN] about ' || c_nationkey AS passed FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'refused', NULL FROM customer WHERE c_custkey % 2 = 1""",
)
def tool_values(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments with a mail and an address: a search is rewritten, a command is refused."""
    rows = _said(spark, sf, "'ask c' || c_custkey || '@mail.com at 10.9.8.' || (c_custkey % 250) || ' about ' || c_nationkey")
    bash = F.col("c_custkey") % 2 == 1
    args = rows.select("c_custkey", F.when(bash, "bash").otherwise("web_search").alias("tool"), F.when(bash, "command").otherwise("query").alias("arg"), F.col("text").alias("value"), F.lit("s").alias("session"))
    rules = spark.createDataFrame(list(fixed.TOOL_RULES), "tool string, arg string, rule string")
    done = guard.scan_calls(args, "c_custkey", rules, session="session", secret=governance.SECRET)
    return done.select("c_custkey", "outcome", F.regexp_replace("rewritten", r"\[PII_[0-9a-f]{10}\]", "[TOKEN]").alias("passed"))


@query(
    "file_values",
    """SELECT c_custkey, 'Of [REDACTED_EMAIL]: [REDACTED_IP_ADDRESS], ' || CASE WHEN c_custkey % 4 = 0 THEN '[REDACTED_CREDIT_CARD]' ELSE 'none' END || ' in ' || c_nationkey AS masked, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 2 END::BIGINT AS findings FROM customer""",
)
def file_values(spark: SparkSession, sf: str) -> DataFrame:
    """Units of files with mails, addresses and cards, masked by label."""
    rows = _said(spark, sf, "'Of c' || c_custkey || '@mail.com: 10.9.' || (c_custkey % 250) || '.1, ' || CASE WHEN c_custkey % 4 = 0 THEN '4111-1111-1111-1111' ELSE 'none' END || ' in ' || c_nationkey")
    scanned = guard.scan_units(rows, fixed.POLICIES["default"])
    return scanned.select("c_custkey", "masked", F.size("decisions").cast("long").alias("findings"))
