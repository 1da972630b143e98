"""Routing and control-plane computations: difficulty, anchors, budgets, buckets, breakers, status."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions import fixed
from veilspan.operators import folds


def difficulty(text: Column) -> Column:
    """simple, moderate or complex, from signals and the word count."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    score = sum(
        (F.when(c, 1).otherwise(0) for c in (text.rlike(fixed.ROBUSTNESS), text.rlike(fixed.LEADING_VERB), words > 30, F.regexp_count(text, F.lit(fixed.CONJUNCTION)) > 3)),
        F.when(text.rlike(fixed.CONCURRENCY), 1).otherwise(0),
    )
    mathematical = text.rlike(fixed.MATH) | (F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit(""))) >= 4)
    hard = (words > 150) | text.rlike(fixed.HARD) | mathematical | (score >= 2)
    numbers = (words <= 50) & (F.regexp_count(text, F.lit(r"\d+")) >= 3)
    return F.when(hard, "complex").when((words > 50) | text.rlike(fixed.MODERATE) | text.rlike(fixed.CHOICES) | numbers, "moderate").otherwise("simple")


def strip_tokens(text: Column) -> Column:
    return F.regexp_replace(text, fixed.TOKEN, "REDACTED")


def tier(corpus_rows: int, labels: int) -> str:
    """Which router a corpus of labelled prompts allows."""
    if corpus_rows < 50 or labels < 2:
        return "anchor_similarity"
    return "word_ngrams" if corpus_rows < 300 else "char_ngrams"


def anchor_route(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Nearest anchor by TF-IDF cosine: key, difficulty, confidence (4 places). The anchors are sixteen
    fixed sentences, so their weights are a broadcast table of a few dozen terms; ties go to the first."""
    spark = texts.sparkSession
    rows = [(i, label, s) for i, (label, s) in enumerate((label, s) for label, some in fixed.ROUTER_ANCHORS.items() for s in some)]
    anchors = spark.createDataFrame(rows, "anchor int, label string, text string")
    terms = lambda t: F.explode(F.regexp_extract_all(F.lower(t), F.lit(r"\b\w\w+\b"), F.lit(0)))
    counts = anchors.select("anchor", "label", terms(F.col("text")).alias("term")).groupBy("anchor", "label", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("term").agg((F.log((1 + F.lit(len(rows))) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weighted = counts.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("anchor").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    anchor_terms = weighted.join(F.broadcast(norms), "anchor").select("anchor", "label", "term", (F.col("w") / F.col("norm")).alias("aw"))
    own = texts.select(*key, terms(F.col(text)).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = own.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.join(F.broadcast(anchor_terms), "term").groupBy(*key, "anchor", "label").agg(F.sum(F.col("w") * F.col("aw")).alias("dot"))
    best = dots.join(length, key).withColumn("sim", F.round(F.col("dot") / F.col("norm"), 9)).groupBy(*key).agg(F.max_by(F.struct("label", "sim"), F.struct("sim", -F.col("anchor"))).alias("best"))
    out = texts.select(*key).join(best, key, "left")
    return out.select(*key, F.coalesce("best.label", F.lit(rows[0][1])).alias("difficulty"), F.round(F.coalesce("best.sim", F.lit(0.0)), 4).alias("confidence"))


def first_over_budget(costs: DataFrame, key: str, order: list[str], cost: str, budget: Column) -> DataFrame:
    """Rows with what was spent before them and whether the budget rejects them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    return costs.withColumn("spent_before", spent).withColumn("rejected", F.coalesce(spent >= budget, F.lit(False)))


def agent_status(last_beat: Column, revoked: Column, now: Column, interval: float = 30.0, missed: int = 3) -> Column:
    return F.when(revoked, "revoked").when(last_beat.isNull(), "enrolled").when(now - last_beat <= interval * missed, "online").otherwise("offline")


def injection(text: Column) -> dict[str, Column]:
    return {"override": text.rlike(fixed.INJECTION_OVERRIDE), "roleplay": text.rlike(fixed.INJECTION_ROLEPLAY), "exfiltration": text.rlike(fixed.INJECTION_EXFILTRATION)}


class Bucket:
    """A token bucket: `rate` tokens a second up to `burst`; full at first."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, float(burst)

    def step(self, state: dict, now: float) -> tuple[bool, float, int]:
        """allowed, tokens left and retry_after_ms of a request."""
        filled = min(self.burst, state["tokens"] + max(now - state["last"], 0.0) * self.rate) if state else self.burst
        allowed = filled >= 1
        state.update(tokens=filled - 1 if allowed else filled, last=now)
        return allowed, state["tokens"], 0 if allowed else math.ceil((1 - filled) / self.rate * 1000)


def segmented(rows: DataFrame, key: str, order: list[str], at: str, gap: float, settled: Column | None = None) -> DataFrame:
    """`rows` with `segment`: parts of a key's order whose state at their start does not hang on what was before, so
    that a key with very many rows is many tasks' work.

    Time is cut into cells of `gap` seconds. Before a key's first row of a cell whose predecessor is empty nothing
    happened for longer than `gap`; there a segment starts or, with `settled`, after that row if it is settled (the row
    itself ends the segment before). Only distinct cells are put in order; rows meet them in an equi-join."""
    at_cell = rows.withColumn("cell", F.floor(F.col(at) / F.lit(gap * (1 + 1e-9))))
    place = F.struct(*order)
    first = F.min(F.struct(place.alias("place"), (F.lit(True) if settled is None else settled).alias("settled"))).alias("first")
    w = Window.partitionBy(key).orderBy("cell")
    starts = F.coalesce((F.col("cell") - F.lag("cell").over(w) > 1) & F.col("first.settled"), F.lit(False))
    cells = at_cell.groupBy(key, "cell").agg(first).withColumn("starts", starts).withColumn("segment", F.sum(F.col("starts").cast("long")).over(w))
    cells = cells.select(F.col(key).alias("cell_key"), F.col("cell").alias("cell_no"), "segment", "starts", F.col("first.place").alias("place"))
    met = at_cell.join(cells, F.col(key).eqNullSafe(F.col("cell_key")) & F.col("cell").eqNullSafe(F.col("cell_no")))
    ends = F.col("starts") & (place == F.col("place")) if settled is not None else F.lit(False)
    return met.withColumn("segment", F.struct(F.col(key).alias("key"), (F.col("segment") - ends.cast("long")).alias("no"))).select(*rows.columns, "segment")


def bucketed(requests: DataFrame, key: str, order: list[str], at: str, rate: float, burst: float) -> DataFrame:
    """Requests with allowed, tokens (left) and retry_after_ms of a token bucket for each key. A bucket is full after
    burst / rate seconds without requests whatever came before, so such gaps part a key's work."""
    parts = segmented(requests, key, order, at, burst / rate)
    return folds.fold(parts, "segment", order, [at], dict, Bucket(rate, burst).step, {"allowed": ("boolean", pa.bool_()), "tokens": ("double", pa.float64()), "retry_after_ms": ("long", pa.int64())}).drop("segment")


def guarded(calls: DataFrame, key: str, order: list[str], at: str, failed: str, threshold: int = 5, open_seconds: float = 30.0) -> DataFrame:
    """Calls with state and allowed of a circuit breaker for each key. After `open_seconds` without calls the next
    one is let through whatever came before, and if it succeeds the breaker is closed: such calls part a key's work."""
    parts = segmented(calls, key, order, at, open_seconds, ~F.coalesce(F.col(failed), F.lit(False)))
    return folds.fold(parts, "segment", order, [at, failed], Breaker(threshold, open_seconds).start, Breaker(threshold, open_seconds).step, {"state": ("string", pa.string()), "allowed": ("boolean", pa.bool_())}).drop("segment")


class Breaker:
    """closed until `threshold` failures in a row; then open for `open_seconds`; then one probe decides."""

    def __init__(self, threshold: int, open_seconds: float):
        self.threshold, self.open_seconds = threshold, open_seconds

    @staticmethod
    def start() -> dict:
        return {"fails": 0, "opened": None}

    def step(self, state: dict, now: float, failed: bool | None) -> tuple[str, bool]:
        opened = state["opened"]
        name = "closed" if opened is None else "half_open" if now - opened >= self.open_seconds else "open"
        if name == "open":
            return name, False
        if not failed:
            state.update(fails=0, opened=None)
        elif name == "half_open":
            state["opened"] = now
        else:
            state["fails"] += 1
            if state["fails"] >= self.threshold:
                state["opened"] = now
        return name, True


def authenticated(requests: DataFrame, keys: DataFrame, header: str = "authorization") -> DataFrame:
    """Requests with `key_id` where their bearer key is known by its hash, active and not forwarded from another
    gateway, and `refused` otherwise. `keys`: key_hash, key_id, active, origin_gateway."""
    raw = F.when(F.col(header).startswith("Bearer "), F.substring(F.col(header), F.lit(8), F.length(header)))
    known = keys.where(F.col("active") & F.col("origin_gateway").isNull()).select("key_hash", "key_id")
    found = requests.withColumn("key_hash", F.sha2(raw, 256)).join(known, "key_hash", "left").drop("key_hash")
    return found.withColumn("refused", F.col("key_id").isNull())


def enrolled(uses: DataFrame, tokens: DataFrame, token: str, order: list[str], at: str = "at") -> DataFrame:
    """Uses of one-time tokens with `outcome`: unknown, expired, used (an earlier valid use took it) or enrolled. `tokens` has
    the token and when it `expires`; a null never does."""
    issued = tokens.select(F.col(token).alias("issued"), F.col("expires").alias("issued_until"))
    known = uses.join(issued, F.col(token) == F.col("issued"), "left").withColumn("valid", F.col("issued").isNotNull() & F.coalesce(F.col(at) <= F.col("issued_until"), F.lit(True)))
    first = known.where("valid").groupBy(token).agg(F.min(F.struct(*order)).alias("first"))
    judged = known.join(first.withColumnRenamed(token, "of"), F.col(token) == F.col("of"), "left")
    outcome = F.when(F.col("issued").isNull(), "unknown").when(~F.col("valid"), "expired").when(F.struct(*order) == F.col("first"), "enrolled").otherwise("used")
    return judged.withColumn("outcome", outcome).select(*uses.columns, "outcome")


def overridden(heuristic: Column, routed: Column, confidence: Column, least: float = 0.4) -> Column:
    """The routed label where there is one of enough confidence, else the heuristic's."""
    return F.when(routed.isNotNull() & (confidence >= least), routed).otherwise(heuristic)


def valid_difficulty(label: Column, *, dynamic: bool = False) -> Column:
    """Whether a label is a difficulty class; `dynamic` is one for registry routes alone."""
    return F.coalesce(label.isin("simple", "moderate", "complex", *(["dynamic"] if dynamic else [])), F.lit(False))


def trained_router(prompts: DataFrame, labelled: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Prompts with `routed` and `confidence` of a class-balanced logistic regression over TF-IDF, fitted on `labelled`
    rows; the features follow the corpus' tier (1- and 2-word grams, or 3- to 5-character grams of padded words). With
    a corpus too small for it both are null."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer
    from pyspark.ml.functions import vector_to_array

    shares = labelled.groupBy(label).count().collect()  # one row a class
    rows = sum(r["count"] for r in shares)
    kind = tier(rows, len(shares))
    if kind == "anchor_similarity":
        return prompts.withColumn("routed", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.slice(words, 1, 0))
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    grams = F.concat(words, pairs) if kind == "word_ngrams" else F.flatten(F.transform(padded, lambda w: F.concat(cut(w, 3), cut(w, 4), cut(w, 5))))
    weight = F.lit(1.0)
    for r in shares:
        weight = F.when(F.col(label) == r[label], rows / (len(shares) * r["count"])).otherwise(weight)
    indexer = StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc")
    stages = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=1 << 16), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="y", weightCol="weight", maxIter=100, regParam=1e-3)]
    names = sorted(r[label] for r in shares)
    model = Pipeline(stages=[indexer, *stages]).fit(labelled.select(label, grams.alias("grams"), weight.alias("weight")))
    scored = prompts.withColumn("grams", grams)
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    at = F.col("prediction").cast("int")
    out = scored.withColumn("routed", F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)).withColumn("confidence", F.element_at(vector_to_array("probability"), at + 1))
    return out.select(*prompts.columns, "routed", "confidence")
