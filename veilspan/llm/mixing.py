"""Mixing documents to target weights of soft domains, in DataFrame operations only.

A naive Bayes classifier of hashed word presence, counted on a bounded sample of the rows that a
label table labels, gives every document posteriors of the domains. Nonnegative rates are then fitted so that each domain's expected tokens, the sum of rate * tokens *
posterior, meet its target: projected gradient steps on the least squares of the totals' relative
errors, where a step sums one row for each domain over the documents and moves every document's rate
by its own posteriors. With the errors divided by the domains' own totals, the steps' matrix has
row sums of one, so a step length of one is safe whatever the data.

The token budget of a mix that keeps the corpus `whole` (the query's and the pipeline's) is what the main
domain, the one with the greatest target, supplies without repeats: a scarce domain never makes the corpus
smaller. A domain with fewer tokens than its target is repeated instead: it allows rates up to what it
lacks, at most REPEATS, and a document's rate may reach the mean of its domains' allowances by its
posteriors (1 where no domain is scarce). What stays under its target all the same is logged as a warning
and can be read from `reached`. Otherwise the budget is the largest total of which every domain can supply
its share with rates up to `most_rate`, and targets come before size.
A document's copies are its rate's whole part, plus one when its hashed key falls under the
rest.

Cases: a null or empty text has no tokens and the prior as posteriors. A label row with a null in any
used column, or of an unknown document, teaches nothing; of repeated labels the smallest counts. Without labels
every posterior is equal and every rate 1, since no choice would change the mix. A domain that no label row teaches, where others
are taught, has posterior 0. A domain without tokens has no target to meet. Repeated rows have equal
rates and copies. A null doc_id is hashed as a key of its own. An empty table gives an empty result.
Columns of the input are carried by `mix`, whatever their names.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

#: Target share of the tokens of each domain.
TARGETS = {"good": 0.90, "low": 0.06, "toxic": 0.04}
BUCKETS, SAMPLE_ROWS, SMOOTHING = 1 << 14, 10_000, 0.5
STEPS, TOLERANCE, STALLED, STEPS_A_TABLE = 100, 1e-6, 1e-4, 10
#: Most copies on average for a domain with fewer tokens than its target.
REPEATS = 16.0
UNTAUGHT = -1e300
BLANK = "[ \t\n\v\f\r]+"

_log = logging.getLogger(__name__)


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic before low quality before good."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good").alias("domain"))


def _words(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda w: w != "")


def _present(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def fit_domains(documents: DataFrame, labels: DataFrame, domains: list[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row: for each domain d the prior's logarithm `l_d` and the array `w_d` of the buckets' log
    probabilities; `taught`, the number of label rows used."""
    known = domain_of_labels(labels).join(documents.select("doc_id").distinct(), "doc_id")
    chosen = common.bounded_sample(known, "doc_id", sample_rows)
    seen = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", _present(_words()).alias("present"))
    seen = common.materialize(seen, "mixing-sample")
    counts = seen.select("domain", F.explode("present").alias("bucket")).groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"c_{d}") for d in domains])
    every = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", *[F.coalesce(f"c_{d}", F.lit(0)).alias(f"c_{d}") for d in domains])
    totals = [F.sum(f"c_{d}").alias(f"t_{d}") for d in domains]
    arrays = F.array_sort(F.collect_list(F.struct("bucket", *[f"c_{d}" for d in domains]))).alias("rows")  # BUCKETS entries
    one = filled.agg(arrays, *totals)
    logs = {d: _log_shares(f"c_{d}", f"t_{d}") for d in domains}
    weighted = one.select(*[v.alias(f"w_{d}") for d, v in logs.items()])
    of, rows = {d: F.count_if(F.col("domain") == d) for d in domains}, F.count(F.lit(1))
    known_prior = {d: F.log((of[d] + 1) / (rows + len(domains))) for d in domains}
    priors = seen.agg(rows.alias("taught"), *[F.when((of[d] == 0) & (rows > 0), F.lit(UNTAUGHT)).otherwise(known_prior[d]).alias(f"l_{d}") for d in domains])
    joined = weighted.withColumn("one", F.lit(1)).join(priors.withColumn("one", F.lit(1)), "one").drop("one")
    return common.materialize(joined, "mixing-model")


def _log_shares(count: str, total: str) -> Column:
    return F.transform("rows", lambda r: F.log((r[count] + SMOOTHING) / (F.col(total) + SMOOTHING * BUCKETS)))


def _summed(weights: str, present: str) -> Column:
    """The sum of a bucket table's entries over the buckets present."""
    return F.aggregate(present, F.lit(0.0), lambda total, b: total + F.get(weights, b))


def with_posteriors(documents: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """`documents` with n_tokens and p_<domain> appended. The model is one row of fixed size."""
    top, *scores = common.spare_names(documents, "top", *[f"s_{d}" for d in domains])
    words, present, one = common.spare_names(documents, "words", "present", "one")
    rows = documents.withColumn(words, _words()).withColumn("n_tokens", F.size(words).cast("long")).withColumn(present, _present(F.col(words))).drop(words)
    named = model.select(F.lit(1).alias(one), *[F.col(c).alias(n) for c, n in zip(model.columns, common.spare_names(rows, *model.columns), strict=True)])
    of = dict(zip(model.columns, named.columns[1:], strict=True))
    scored = rows.withColumn(one, F.lit(1)).join(F.broadcast(named), one)
    for d, score in zip(domains, scores, strict=True):
        scored = scored.withColumn(score, F.col(of[f"l_{d}"]) + _summed(of[f"w_{d}"], present))
    scored = scored.drop(one, present, *of.values())
    scored = scored.withColumn(top, F.greatest(*scores) if len(domains) > 1 else F.col(scores[0]))
    parts = {d: F.exp(F.col(score) - F.col(top)) for d, score in zip(domains, scores, strict=True)}
    whole = sum(parts.values(), F.lit(0.0))
    return scored.withColumns({f"p_{d}": part / whole for d, part in parts.items()}).drop(top, *scores)


def _tokens_of(rows: DataFrame, domains: list[str], weight: Column) -> dict[str, float]:
    return rows.agg(*[F.coalesce(F.sum(weight * F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in domains]).first().asDict()


@dataclass(frozen=True)
class Fit:
    """Fitted rates as a function of a document's posteriors: what each projected step moved by."""

    most: dict[str, float]
    steps: tuple[dict[str, float], ...]
    #: For each domain, the tokens reached and those wanted.
    tokens: dict[str, tuple[float, float]]

    def upper(self) -> Column:
        """The largest rate that a document's posteriors allow."""
        if len(set(self.most.values())) == 1:
            return F.lit(next(iter(self.most.values())))
        return sum((F.col(f"p_{d}") * F.lit(m) for d, m in self.most.items()), F.lit(0.0))

    def rate(self) -> Column:
        """The rate, by all steps again on the row's own posteriors."""
        domains = list(self.most)
        most, own = self.upper(), {d: F.col(f"p_{d}") for d in domains}
        start = F.least(F.lit(1.0), most)
        if not self.steps:
            return start
        errors = F.array(*[F.struct(*[F.lit(e[d]).alias(d) for d in domains]) for e in self.steps])
        return F.aggregate(errors, start, lambda rate, e: _moved(rate, {d: e[d] for d in domains}, own, most))


def _moved(rate: Column, error: dict[str, Column], own: dict[str, Column], most: Column) -> Column:
    return F.least(most, F.greatest(F.lit(0.0), rate - sum((own[d] * error[d] for d in own), F.lit(0.0))))


def fit_steps(rows: DataFrame, targets: dict[str, float], *, tokens: float | None = None, most_rate: float = 1.0, whole: bool = False) -> Fit:
    """The rates of `rows` (n_tokens and p_<domain>). Steps end when every domain's relative error is
    within TOLERANCE, when the greatest hardly falls and none moves by STALLED any more (the bounds of the rates
    leave no better fit), or after STEPS of them; what then is left is logged and stands in the fit's `tokens`."""
    domains = list(targets)
    all_targets = sum(targets.values())
    totals = _tokens_of(rows, domains, F.lit(1.0))
    shares = {d: targets[d] / all_targets for d in domains}
    supplied = {d: totals[d] / shares[d] for d in domains if shares[d] and totals[d]}
    if tokens is not None:
        budget = tokens
    elif whole:
        budget = supplied[max(supplied, key=lambda d: shares[d])] if supplied else 0.0
    else:
        budget = min((most_rate * s for s in supplied.values()), default=0.0)
    lacking = {d: budget * shares[d] / totals[d] if totals[d] else 1.0 for d in domains}
    scarce = whole and max(lacking.values()) > 1 + 1e-9
    fit = Fit({d: min(REPEATS, max(1.0, lacking[d])) if scarce else most_rate for d in domains}, (), {})
    own = {d: F.col(f"p_{d}") for d in domains}
    state = rows.select("n_tokens", *own.values()).withColumn("most", fit.upper()).withColumn("rate", F.least(F.lit(1.0), F.col("most")))
    supply = _tokens_of(state, domains, F.col("most"))
    wanted = {d: min(budget * shares[d], supply[d]) if whole else budget * shares[d] for d in domains}
    steps: list[dict[str, float]] = []
    now = _tokens_of(state, domains, F.col("rate"))
    while True:
        error = {d: (now[d] - wanted[d]) / totals[d] if totals[d] else 0.0 for d in domains}
        greatest = max(map(abs, error.values()))
        stalled = bool(steps) and greatest > 0.95 * max(map(abs, steps[-1].values())) and max(abs(error[d] - steps[-1][d]) for d in domains) <= STALLED
        if greatest <= TOLERANCE or stalled or len(steps) == STEPS:
            break
        steps.append(error)
        state = state.withColumn("rate", _moved(F.col("rate"), {d: F.lit(e) for d, e in error.items()}, own, F.col("most")))
        if len(steps) % STEPS_A_TABLE == 0:
            state = common.materialize(state, "mixing-rates")
        now = _tokens_of(state, domains, F.col("rate"))
    for d in domains:
        if abs(error[d]) > TOLERANCE:
            _log.warning("domain %s: relative error %.2g left after %d steps", d, error[d], len(steps))
        if now[d] < 0.99 * budget * shares[d]:
            _log.warning("domain %s stays under its target: %.0f of %.0f tokens", d, now[d], budget * shares[d])
    return Fit(fit.most, tuple(steps), {d: (now[d], wanted[d]) for d in domains})


def fit_rates(rows: DataFrame, targets: dict[str, float], **how: float) -> DataFrame:
    """`rows` (n_tokens and p_<domain>) with `rate` appended."""
    return rows.withColumn("rate", fit_steps(rows, targets, **how).rate())


def reached(rated: DataFrame, targets: dict[str, float] = TARGETS) -> dict[str, tuple[float, float]]:
    """For each domain its target share and the share of the tokens that the rates of `rates` give it."""
    got, whole = _tokens_of(rated, list(targets), F.col("rate")), sum(targets.values())
    return {d: (t / whole, got[d] / (sum(got.values()) or 1.0)) for d, t in targets.items()}


def _rate(rows: DataFrame, model: DataFrame, targets: dict[str, float], how: dict[str, float]) -> Column:
    if not model.select("taught").first()[0]:
        _log.warning("no label row names a domain: every document is kept once")
        return F.lit(1.0)
    return fit_steps(rows, targets, **how).rate()


def _copies(key: Column, rate: Column) -> Column:
    uniform = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(uniform < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, **how: float) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of every document."""
    domains = list(targets)
    model = fit_domains(documents, labels, domains)
    rows = common.materialize(with_posteriors(documents.select("doc_id", "text"), model, domains).drop("text"), "mixing-posteriors")
    return rows.withColumn("rate", _rate(rows, model, targets, how)).withColumn("copies", _copies(F.col("doc_id"), F.col("rate")))


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, whole: bool = True, **how: float) -> DataFrame:
    """The documents, columns unchanged, each as often as its rate says. The rate is computed in the row
    from its posteriors and the steps' errors, so no text is shuffled."""
    domains = list(targets)
    inner = [f"c{i}" for i in range(len(documents.columns))]
    model = fit_domains(documents, labels, domains)
    renamed = documents.toDF(*inner).withColumns({"doc_id": F.col(inner[documents.columns.index("doc_id")]), "text": F.col(inner[documents.columns.index("text")])})
    rows = common.materialize(with_posteriors(renamed, model, domains).drop("text"), "mixing-posteriors")
    rate = _rate(rows, model, targets, {"whole": whole, **how})
    copied = rows.withColumn("rate", rate).withColumn("copies", _copies(F.col("doc_id"), F.col("rate"))).where("copies > 0")
    again = copied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(i).alias(c) for i, c in zip(inner, documents.columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), whole=True)
