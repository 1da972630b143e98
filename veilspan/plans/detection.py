"""Detection, normalization and span queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import expressions as E
from veilspan.functions import fixed, text
from veilspan.operators import detection, spans
from veilspan.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def doubled(column: str) -> str:
    """RE2 has no lookaround: with every non-digit doubled, a match can take its neighbours along."""
    return rf"regexp_replace({column}, '(\D)', '\1\1', 'g')"


CORE = detection.named("email", "ipv4", "phone", "card", "secret_cued", "access_key", "secret_tag")


@query("detect_email", f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(fixed.EMAIL)})) AS hit FROM documents")
def detect_email(spark: SparkSession, sf: str) -> DataFrame:
    return detection.detect(table(spark, sf, "documents"), detection.named("email"), keep=["doc_id"]).select("doc_id", F.col("text").alias("hit"))


@query("detect_ipv4", f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(fixed.IPV4)})) AS hit FROM documents")
def detect_ipv4(spark: SparkSession, sf: str) -> DataFrame:
    return detection.detect(table(spark, sf, "documents"), detection.named("ipv4"), keep=["doc_id"]).select("doc_id", F.col("text").alias("hit"))


_IPV6_TEXT = "'host fe80:' || (c_custkey % 10000) || ':ab:1 and ' || c_nationkey || ':2 up'"


@query("detect_ipv6", f"SELECT c_custkey, unnest(regexp_extract_all({_IPV6_TEXT}, {quoted(fixed.IPV6)})) AS hit FROM customer")
def detect_ipv6(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_IPV6_TEXT).alias("text"))
    return detection.detect(rows, detection.named("ipv6"), keep=["c_custkey"]).select("c_custkey", F.col("text").alias("hit"))


@query(
    "detect_phone_nanp",
    rf"""SELECT doc_id, regexp_replace(hit, '\D', '', 'g') AS digits FROM (
    SELECT doc_id, unnest(regexp_extract_all({doubled("text")}, '(?:^|\D)((?:(?:\+\+)?1(?:[\s.\-]{{2}})?)?(?:\(\()?\d{{3}}(?:\)\))?(?:[\s.\-]{{2}})?\d{{3}}(?:[\s.\-]{{2}})?\d{{4}})(?:\D|$)', 1)) AS hit FROM documents)""",
)
def detect_phone_nanp(spark: SparkSession, sf: str) -> DataFrame:
    return detection.detect(table(spark, sf, "documents"), detection.named("phone"), keep=["doc_id"]).select("doc_id", E.digits(F.col("text")).alias("digits"))


_LUHN_SQL = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN 2 * d[i]::INT > 9 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END ELSE d[i]::INT END)) % 10 = 0"


@query(
    "detect_card_run",
    rf"""SELECT doc_id, d AS digits, {_LUHN_SQL} AS luhn_ok FROM (
    SELECT doc_id, unnest(regexp_extract_all({doubled("text")}, '(?:^|\D)(\d{{13,19}})(?:\D|$)', 1)) AS d FROM documents)""",
)
def detect_card_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<!\d)\d{13,19}(?!\d)"), F.lit(0))).alias("digits"))
    return rows.select("doc_id", "digits", F.call_function("luhn_check", F.col("digits")).alias("luhn_ok"))


@query("detect_card_candidate")
def detect_card_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return detection.detect(table(spark, sf, "documents"), detection.named("card"), keep=["doc_id"]).drop("ord")


_IDS = """CASE c_custkey % 5 WHEN 0 THEN lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '1') || '-45-' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '2')
 WHEN 1 THEN lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '1') || ' 45 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '2')
 WHEN 2 THEN '123-' || lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '4') || '-789'
 WHEN 3 THEN '12.34.' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '5')
 ELSE lpad(CAST(c_custkey AS VARCHAR(9)), 9, '7') END"""


@query(
    "detect_gov_id",
    f"""SELECT c_custkey, {_IDS} AS hit, CASE c_custkey % 5 WHEN 0 THEN 'ssn-dashed' WHEN 1 THEN 'ssn-spaced' WHEN 2 THEN 'gov-id-grouped3' WHEN 3 THEN 'gov-id-dotted' ELSE 'ssn-plain' END AS format,
    CASE c_custkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 WHEN 3 THEN 0.85 ELSE 0.55 END::DOUBLE AS confidence FROM customer""",
)
def detect_gov_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(f"'My id: ' || {_IDS} || '; thanks'").alias("text"))
    found = detection.detect(rows, [f for f in detection.FAMILIES if f.ledger == "gov"], keep=["c_custkey"])
    return found.select("c_custkey", F.col("text").alias("hit"), "format", "confidence")


_DATE_TEXT = "'Due ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) || ' at ' || (o_orderkey % 12 + 1) || ':30 pm, ref ' || o_orderkey"


@query("detect_dates", f"SELECT o_orderkey, unnest(regexp_extract_all({_DATE_TEXT}, {quoted(fixed.DATE_NUMERIC)})) AS hit FROM orders")
def detect_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_DATE_TEXT.replace("AS VARCHAR(10)", "AS STRING")).alias("text"))
    return detection.detect(rows, detection.named("date-numeric"), keep=["o_orderkey"]).select("o_orderkey", F.col("text").alias("hit"))


@query("detect_times", f"SELECT o_orderkey, unnest(regexp_extract_all({_DATE_TEXT}, {quoted(fixed.TIME)})) AS hit FROM orders")
def detect_times(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_DATE_TEXT.replace("AS VARCHAR(10)", "AS STRING")).alias("text"))
    return detection.detect(rows, detection.named("date-numeric", "time"), keep=["o_orderkey"]).where("format = 'time'").select("o_orderkey", F.col("text").alias("hit"))


_HANDLE_TEXT = "'by @user_' || c_custkey || ' and mail@host' || c_custkey || ' near [12.5, -' || c_nationkey || '.25]'"


@query("detect_handles", "SELECT c_custkey, '@user_' || c_custkey AS hit FROM customer")
def detect_handles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_HANDLE_TEXT).alias("text"))
    return detection.detect(rows, detection.named("handle"), keep=["c_custkey"]).select("c_custkey", F.col("text").alias("hit"))


@query("detect_geo", f"SELECT c_custkey, unnest(regexp_extract_all({_HANDLE_TEXT}, {quoted(fixed.GEO)})) AS hit FROM customer")
def detect_geo(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_HANDLE_TEXT).alias("text"))
    return detection.detect(rows, detection.named("geocoord"), keep=["c_custkey"]).select("c_custkey", F.col("text").alias("hit"))


@query("detect_secrets", f"SELECT doc_id, len(hit)::BIGINT AS value_len, hit FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(fixed.SECRET_CUED)}, 1)) AS hit FROM documents)")
def detect_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.detect(table(spark, sf, "documents"), detection.named("secret_cued"), keep=["doc_id"])
    return found.select("doc_id", F.length("text").cast("long").alias("value_len"), F.col("text").alias("hit"))


_STAFF = "'Sales Manager of Globex Labs' || c_custkey || ' Inc. paid by Mastercard, Female, c/o ' || c_name"
for _name, _family in (("titles", "title_vocab"), ("demographics", "demographic_vocab"), ("orgs", "org_suffix"), ("card_issuers", "card_issuer_vocab")):

    def _vocabulary(spark: SparkSession, sf: str, family: str = _family) -> DataFrame:
        rows = table(spark, sf, "customer").select("c_custkey", F.expr(_STAFF).alias("text"))
        return detection.detect(rows, detection.named(family), keep=["c_custkey"]).select("c_custkey", F.col("text").alias("hit"))

    query(f"detect_{_name}", f"SELECT c_custkey, unnest(regexp_extract_all({_STAFF}, {quoted(detection.BY_NAME[_family].pattern)})) AS hit FROM customer")(_vocabulary)


_UAE = "'Office Dubai, P.O. Box ' || (c_custkey % 100000) || ' lic CN-' || lpad(CAST(c_custkey AS VARCHAR(9)), 6, '1') || ' id 784-1990-' || lpad(CAST(c_custkey AS VARCHAR(9)), 7, '3') || '-5'"


@query(
    "detect_uae",
    f"""SELECT c_custkey, format, hit FROM (
    SELECT c_custkey, 'uae_emirate_name' AS format, unnest(regexp_extract_all({_UAE}, {quoted(fixed.EMIRATE_NAME)})) AS hit FROM customer
    UNION ALL SELECT c_custkey, 'uae_po_box', unnest(regexp_extract_all({_UAE}, {quoted(fixed.UAE_PO_BOX)})) FROM customer
    UNION ALL SELECT c_custkey, 'uae_trade_license', unnest(regexp_extract_all({_UAE}, {quoted(fixed.UAE_TRADE_LICENCE)})) FROM customer
    UNION ALL SELECT c_custkey, 'uae_emirates_id', unnest(regexp_extract_all({_UAE}, {quoted(fixed.EMIRATES_ID)})) FROM customer)""",
)
def detect_uae(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_UAE).alias("text"))
    found = detection.detect(rows, [f for f in detection.FAMILIES if f.name.startswith("uae_") and f.pack == "base_en"], keep=["c_custkey"])
    return found.select("c_custkey", "format", F.col("text").alias("hit"))


_NUMBERS = ("lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR(12)), 9, '0')", "lpad(CAST(c_custkey * 104729 % 1000000000 AS VARCHAR(12)), 10, '2')")
_SA, _KW, _UA = f"'1' || {_NUMBERS[0]}", f"'2' || {_NUMBERS[0]} || '0' || (c_custkey % 10)", f"'78419' || {_NUMBERS[1]}"


def _digit(list_name: str, i: str) -> str:
    return f"substr({list_name}, {i}, 1)::INT"


@query(
    "gulf_checksums",
    f"""SELECT c_custkey,
    list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * {_digit("sa", "i")} < 10 THEN 2 * {_digit("sa", "i")} ELSE 2 * {_digit("sa", "i")} - 9 END ELSE {_digit("sa", "i")} END)) % 10 = 0 AS sa_ok,
    (11 - kwsum % 11) < 10 AND (11 - kwsum % 11) = {_digit("kw", "12")} AS kw_ok,
    (list_sum(list_transform(range(1, 15), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * {_digit("ua", "i")} > 9 THEN 2 * {_digit("ua", "i")} - 9 ELSE 2 * {_digit("ua", "i")} END ELSE {_digit("ua", "i")} END)) * 9) % 10 = {_digit("ua", "15")} AS uae_ok
    FROM (SELECT *, list_sum(list_transform(range(1, 12), lambda i: {_digit("kw", "i")} * [{", ".join(map(str, fixed.KUWAIT_WEIGHTS))}][i])) AS kwsum
      FROM (SELECT c_custkey, {_SA} AS sa, {_KW} AS kw, {_UA} AS ua FROM customer))""",
)
def gulf_checksums(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_SA).alias("sa"), F.expr(_KW).alias("kw"), F.expr(_UA).alias("ua"))
    return rows.select("c_custkey", E.saudi_checksum(F.col("sa")).alias("sa_ok"), E.kuwait_checksum(F.col("kw")).alias("kw_ok"), E.uae_checksum(F.col("ua")).alias("uae_ok"))


@query(
    "gulf_id_scores",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'qa_qid' ELSE 'om_civil_number' END AS id_type,
    round(CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.3 END + CASE WHEN c_custkey % 3 = 0 THEN 0.15 ELSE 0 END, 6)::DOUBLE AS confidence FROM customer""",
)
def gulf_id_scores(spark: SparkSession, sf: str) -> DataFrame:
    number = F.expr(f"CASE WHEN c_custkey % 2 = 0 THEN '2' || {_NUMBERS[0]} || '1' ELSE '9' || substr({_NUMBERS[0]}, 3, 7) END")
    cue = F.when(F.col("c_custkey") % 3 == 0, "رقم ").otherwise("no ")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(cue, number).alias("text"))
    gulf = [f for f in detection.FAMILIES if f.pack == "gulf_ar"]
    return detection.detect(rows, gulf, keep=["c_custkey"]).select("c_custkey", F.col("format").alias("id_type"), F.round("confidence", 6).alias("confidence"))


_ARABIC = f"translate({_NUMBERS[0]}, '0123456789', '{fixed.ARABIC_INDIC_DIGITS}')"


@query("digit_fold", f"SELECT c_custkey, {_NUMBERS[0]} AS folded FROM customer")
def digit_fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.fold_arabic_digits(F.expr(_ARABIC)).alias("folded"))


@query("normalize_zero_width", "SELECT c_custkey, c_name || '@x.org' AS clean, len(c_name)::BIGINT + 6 AS kept FROM customer")
def normalize_zero_width(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit("​@x﻿.org⁠")).alias("text"))
    return rows.select("c_custkey", text.drop_zero_width(F.col("text")).alias("clean"), F.size(text.offset_map(F.col("text"))).cast("long").alias("kept"))


@query("normalize_fullwidth", "SELECT c_custkey, c_name AS clean FROM customer")
def normalize_fullwidth(spark: SparkSession, sf: str) -> DataFrame:
    wide = F.translate("c_name", "0123456789#", "０１２３４５６７８９＃")
    return table(spark, sf, "customer").select("c_custkey", text.normalize(wide).alias("clean"))


@query("normalize_spaced", "SELECT c_custkey, 'write to user now' AS clean FROM customer")
def normalize_spaced(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.normalize(F.lit("write to u s e r now")).alias("clean"))




@query(
    "sentence_count",
    rf"""SELECT doc_id, count(*) AS n, max(len(s))::BIGINT AS longest FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]+["''\)\]]*(?:\s+|$))', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) WHERE regexp_matches(s, '\S') GROUP BY doc_id""",
)
def sentence_count(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences without the abbreviation rule, so that RE2 can express it."""
    marked = F.regexp_replace("text", f"({fixed.SENTENCE_END})", "$1\u0001")
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split(marked, "\u0001")).alias("s")).where(F.col("s").rlike(r"\S"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("sentences_abbreviated")
def sentences_abbreviated(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return text.sentences(rows, keep=("conv_id", "turn")).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query(
    "span_offsets",
    f"""SELECT doc_id, len(list_aggregate(gaps[1:i], 'string_agg', '') || list_aggregate([''] || hits[1:i - 1], 'string_agg', ''))::INT AS start, hits[i] AS hit FROM (
    SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {quoted(fixed.EMAIL)}) AS hits, regexp_split_to_array(text, {quoted(fixed.EMAIL)}) AS gaps FROM documents) WHERE len(hits) > 0)""",
)
def span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return detection.detect(table(spark, sf, "documents"), detection.named("email"), keep=["doc_id"]).select("doc_id", "start", F.col("text").alias("hit"))


_SPANS = "SELECT o_custkey AS unit, o_orderkey AS ord, CAST(o_orderkey % 97 AS INT) AS start, CAST(o_orderkey % 97 + 3 + o_custkey % 7 AS INT) AS \"end\", CASE WHEN o_orderkey % 3 = 0 THEN 'EMAIL' WHEN o_orderkey % 3 = 1 THEN 'PHONE' ELSE 'PERSON' END AS label FROM orders"


def _derived_spans(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("veilspan_orders")
    return spark.sql(_SPANS.replace('"end"', "`end`").replace("FROM orders", "FROM veilspan_orders"))


@query(
    "span_overlap_pairs",
    f"""WITH s AS ({_SPANS}) SELECT a.unit, count(*) AS n FROM s a JOIN s b ON a.unit = b.unit AND a.start < b."end" AND b.start < a."end" WHERE a.label = 'EMAIL' AND b.label = 'PHONE' GROUP BY a.unit""",
)
def span_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _derived_spans(spark, sf)
    return spans.overlapping(rows.where("label = 'EMAIL'"), rows.where("label = 'PHONE'"), "unit").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query(
    "protected_ranges",
    f"""WITH s AS ({_SPANS}) SELECT unit, start, "end", label FROM s a WHERE label <> 'PERSON' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.label = 'PERSON' AND a.unit = b.unit AND a.start < b."end" AND b.start < a."end")""",
)
def protected_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _derived_spans(spark, sf)
    return spans.without_overlap(rows.where("label <> 'PERSON'"), rows.where("label = 'PERSON'"), "unit").select("unit", "start", "end", "label")


@query(
    "locked_precedence",
    f"""WITH s AS ({_SPANS}) SELECT unit, ord, label FROM s a WHERE label <> 'EMAIL' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.label = 'EMAIL' AND a.unit = b.unit AND a.start < b."end" AND b.start < a."end")
    UNION ALL SELECT unit, ord, label FROM s WHERE label = 'EMAIL'""",
)
def locked_precedence(spark: SparkSession, sf: str) -> DataFrame:
    rows = _derived_spans(spark, sf)
    return spans.locked_first(rows.where("label = 'EMAIL'"), rows.where("label <> 'EMAIL'"), "unit").select("unit", "ord", "label")


@query(
    "span_gap_merge",
    """WITH s AS (SELECT o_custkey AS unit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey FROM orders),
    t AS (SELECT unit, i, (i * 10)::INT AS start, (i * 10 + CASE WHEN o_orderkey % 2 = 0 THEN 8 ELSE 5 END)::INT AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'ORG' ELSE 'PERSON' END AS label FROM s),
    m AS (SELECT *, CASE WHEN lag(label) OVER w = label AND start - lag(e) OVER w BETWEEN 1 AND 3 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY unit ORDER BY start)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY start) AS island FROM m)
    SELECT unit, min(start) AS start, max(e) AS "end", any_value(label) AS label, count(*) AS parts FROM g GROUP BY unit, island""",
)
def span_gap_merge(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey", i.alias("ord"))
    made = rows.select(
        "unit", "ord", (F.col("ord") * 10).alias("start"), (F.col("ord") * 10 + F.when(F.col("o_orderkey") % 2 == 0, 8).otherwise(5)).alias("end"),
        F.when(F.col("o_orderkey") % 5 == 0, "ORG").otherwise("PERSON").alias("label"), F.lit(0.9).alias("confidence"), F.repeat(F.lit(" "), 1000).alias("text"),
    )
    return spans.merge_gaps(made, "unit", "text").select("unit", "start", "end", "label", "parts")


@query("span_resolve")
def span_resolve(spark: SparkSession, sf: str) -> DataFrame:
    rows = _derived_spans(spark, sf).withColumn("confidence", F.lit(0.5) + F.col("ord") % 40 / 100)
    listed = rows.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end", "label", "confidence", F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("source")))).alias("s"))
    return listed.select("unit", F.explode(spans.resolve(F.col("s"))).alias("r")).groupBy("unit", "r.how").agg(F.count(F.lit(1)).alias("n"))


@query(
    "locked_anchors",
    """SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 24 ELSE 12 END)::INT AS start, (CASE WHEN c_custkey % 3 = 0 THEN 24 ELSE 12 END + 13 + len(c_custkey::VARCHAR))::INT AS "end",
    'user' || c_custkey || '@mail.org' AS text, 'EMAIL' AS label, c_custkey % 3 = 0 AS negated, (CASE WHEN c_custkey % 3 = 0 THEN 0.9 ELSE 0.95 END)::DOUBLE AS confidence FROM customer""",
)
def locked_anchors(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.when(F.col("c_custkey") % 3 == 0, "This is not my").otherwise("My"), F.lit(" email is user"), F.col("c_custkey").cast("string"), F.lit("@mail.org. Bye."))
    rows = text.sentences(table(spark, sf, "customer").select("c_custkey", said.alias("text")), keep=("c_custkey",))
    return detection.locked_spans(rows, "sentence", keep=["c_custkey"])


@query(
    "context_suppression",
    r"""WITH s AS (SELECT c_custkey, unnest(range(0, 5)) AS idx FROM customer)
    SELECT c_custkey, idx::INT AS idx FROM s WHERE abs(idx - c_custkey % 5) = 1""",
)
def context_suppression(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.when(F.col("c_custkey") % 5 == i, f"Write to a{i}@b.com. ").otherwise(f"Line number {i}. ") for i in range(5)]
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(*parts).alias("text"))
    hits = detection.detect(rows, detection.named("email"), keep=["c_custkey"])
    return spans.context_ranges(text.sentences(rows, keep=("c_custkey",)), hits, "c_custkey").select("c_custkey", "idx")


@query("pipeline_full")
def pipeline_full(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run: normalize, detect with every family of the base pack, map back, repair, lock, merge; counted by label."""
    found = detection.run(table(spark, sf, "documents"), keep=["doc_id"])
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


_HIDDEN = "'Write to u s e r and \u200bc' || c_custkey || '@mail\u200b.com, my email is k' || c_custkey || '@mail.org.'".replace("\\u200b", "\u200b")


@query(
    "pipeline_original_offsets",
    "SELECT c_custkey, 22::INT AS start, (33 + len(c_custkey::VARCHAR))::INT AS \"end\", 'c' || c_custkey || '@mail' || chr(8203) || '.com' AS hit, 'regex' AS source FROM customer UNION ALL SELECT c_custkey, (47 + len(c_custkey::VARCHAR))::INT, (57 + 2 * len(c_custkey::VARCHAR))::INT, 'k' || c_custkey || '@mail.org', 'locked' FROM customer",
)
def pipeline_original_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Spans found in the normalized text stand at their places in the original; the anchored address is locked."""
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_HIDDEN).alias("text"))
    found = detection.run(rows, ner=False, keep=["c_custkey"]).where("label = 'EMAIL'")
    return found.select("c_custkey", "start", "end", F.col("text").alias("hit"), "source")


@query(
    "detect_arabic_digits",
    f"SELECT c_custkey, translate('2' || {_NUMBERS[0]} || '1', '0123456789', '{fixed.ARABIC_INDIC_DIGITS}') AS hit, 'qa_qid' AS format, 0.65::DOUBLE AS confidence FROM customer",
)
def detect_arabic_digits(spark: SparkSession, sf: str) -> DataFrame:
    """Identity numbers in Arabic-Indic digits, cut from the text as they stand."""
    number = f"translate('2' || {_NUMBERS[0]} || '1', '0123456789', '{fixed.ARABIC_INDIC_DIGITS}')"
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("رقم "), F.expr(number)).alias("text"))
    found = detection.detect(rows, [f for f in detection.FAMILIES if f.pack == "gulf_ar"], keep=["c_custkey"])
    return found.select("c_custkey", F.col("text").alias("hit"), "format", F.round("confidence", 6).alias("confidence"))


@query(
    "detect_fields",
    "SELECT c_custkey, 'field_cue_name' AS format, 12::INT AS start, c_name AS hit FROM customer UNION ALL SELECT c_custkey, 'tag_cue', (12 + len(c_name) + 9)::INT, 'name' FROM customer UNION ALL SELECT c_custkey, 'field_cue_address', (12 + len(c_name) + 9 + 4 + 7 + 10)::INT, 'Town' || c_nationkey FROM customer",
)
def detect_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields named by a cue, at the value's own place even where the value also occurs in the cue."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("First name: "), "c_name", F.lit("\n; <name>name</name>\nCountry: Town"), "c_nationkey").alias("text"))
    found = detection.detect(rows, detection.named("field_cue_name", "tag_cue", "field_cue_address"), keep=["c_custkey"])
    return found.select("c_custkey", "format", "start", F.col("text").alias("hit"))


@query(
    "locked_conflicts",
    """WITH s AS (SELECT o_custkey AS unit, o_orderkey % 40 AS start, o_orderkey % 40 + 6 AS e, (o_orderkey % 3) / 10.0 + 0.5 AS confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    p AS (SELECT * FROM s WHERE i <= 2), a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY unit ORDER BY start, e, confidence, i) = 1), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY unit ORDER BY start, e, confidence, i) = 2)
    SELECT unit, CASE WHEN b.unit IS NULL THEN 1 WHEN a.start < b.e AND b.start < a.e THEN 1 ELSE 2 END::INT AS n,
    CASE WHEN b.unit IS NOT NULL AND a.start < b.e AND b.start < a.e AND b.confidence > a.confidence THEN b.start ELSE a.start END::INT AS first FROM a LEFT JOIN b USING (unit)""",
)
def locked_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Two locked spans in conflict: the later one wins only by a greater confidence."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    start = (F.col("o_orderkey") % 40).cast("int")
    rows = table(spark, sf, "orders").withColumn("i", i).where("i <= 2").select(F.col("o_custkey").alias("unit"), F.struct(start.alias("start"), (start + 6).alias("end"), (F.col("o_orderkey") % 3 / 10 + 0.5).alias("confidence"), "i").alias("s"))
    kept = rows.groupBy("unit").agg(spans.locked_resolved(F.collect_list("s")).alias("k"))
    return kept.select("unit", F.size("k").alias("n"), F.array_min(F.transform("k", lambda x: x["start"])).alias("first"))
