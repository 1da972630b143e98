"""Policies as dimension tables, and the decisions that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import fixed

ACTIONS = ("REVERSIBLE", "PRESERVE", "BLOCK")


def validate(rules: dict[str, tuple]) -> None:
    """Refuse unknown labels and actions, and confidences outside 0 to 1."""
    for label, (action, least, below) in rules.items():
        if label not in fixed.PRIORITY:
            raise ValueError(f"unknown label {label}")
        if action not in ACTIONS or (below is not None and below not in ACTIONS):
            raise ValueError(f"unknown action for {label}")
        if least is not None and not 0 <= least <= 1:
            raise ValueError(f"confidence of {label} is not between 0 and 1")


def rules_table(spark: SparkSession, policies: dict[str, dict[str, tuple]] | None = None) -> DataFrame:
    """policy_id, label, action, min_confidence, below_action: one row for each rule."""
    policies = policies or fixed.POLICIES
    rows = []
    for policy, rules in policies.items():
        validate(rules)
        rows += [(policy, label, *rule) for label, rule in rules.items()]
    return spark.createDataFrame(rows, "policy_id string, label string, action string, min_confidence double, below_action string")


def evaluate(spans: DataFrame, rules: DataFrame, *, negation_action: str | None = "PRESERVE", compressible: int = fixed.COMPRESSIBLE_LENGTH) -> DataFrame:
    """Spans with policy_id, action, rule_id, min_confidence and compressible; `rules` is a few rows of
    one or several policies. Negated spans follow `negation_action` where it is given."""
    joined = spans.join(F.broadcast(rules.withColumnRenamed("action", "rule_action")), "label", "left")
    below = (F.col("confidence") < F.col("min_confidence")) & F.col("below_action").isNotNull()
    action = F.when(F.col("rule_action").isNull(), "PRESERVE").when(below, F.col("below_action")).otherwise(F.col("rule_action"))
    rule = F.when(F.col("rule_action").isNull(), F.concat("label", F.lit(":default_preserve"))).when(below, F.concat("label", F.lit(":below_min_confidence"))).otherwise(F.col("label"))
    if negation_action is not None and "negated" in spans.columns:
        negated = F.coalesce(F.col("negated"), F.lit(False))
        action, rule = F.when(negated, negation_action).otherwise(action), F.when(negated, "locked_span_negation").otherwise(rule)
    out = joined.withColumn("action", action).withColumn("rule_id", rule).drop("rule_action", "below_action")
    return out.withColumn("compressible", (F.col("action") == "PRESERVE") & (F.col("end") - F.col("start") > compressible))


def decide(label: Column, confidence: Column, negated: Column, rules: dict[str, tuple], negation_action: str | None = "PRESERVE") -> tuple[Column, Column]:
    """Action and rule_id of a span by one policy's rules, as a column expression."""
    action, rule = F.lit("PRESERVE"), F.concat(label, F.lit(":default_preserve"))
    for own, (then, least, below) in rules.items():
        under = (confidence < least) if least is not None and below is not None else F.lit(False)
        action = F.when(label == own, F.when(under, below).otherwise(then)).otherwise(action)
        rule = F.when(label == own, F.when(under, f"{own}:below_min_confidence").otherwise(own)).otherwise(rule)
    if negation_action is not None:
        negated = F.coalesce(negated, F.lit(False))
        action, rule = F.when(negated, negation_action).otherwise(action), F.when(negated, "locked_span_negation").otherwise(rule)
    return action, rule


def decided(label: str, confidence: float, negated: bool, rules: dict[str, tuple], negation_action: str | None = "PRESERVE") -> str:
    """The action of `decide` for one span, where spans are at hand in a task."""
    if negated and negation_action is not None:
        return negation_action
    then, least, below = rules.get(label, ("PRESERVE", None, None))
    return below if least is not None and below is not None and confidence < least else then


def verdicts(decisions: DataFrame, key: str) -> DataFrame:
    """verdict, n_block, n_reversible and sorted blocked labels of each unit with spans."""
    counted = decisions.groupBy(key).agg(
        F.count_if(F.col("action") == "BLOCK").alias("n_block"), F.count_if(F.col("action") == "REVERSIBLE").alias("n_reversible"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("action") == "BLOCK", F.col("label")))), ",").alias("blocked_labels"),
    )
    return counted.withColumn("verdict", F.when(F.col("n_block") > 0, "BLOCK").when(F.col("n_reversible") > 0, "ALLOW_WITH_REDACTION").otherwise("ALLOW"))


def label_counts(decisions: DataFrame, key: str) -> DataFrame:
    """`labels`: how many spans of each label a unit has, as a map."""
    counted = decisions.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"))


def load_policies(spark: SparkSession, folder: str) -> DataFrame:
    """policy_id, version, label, action, min_confidence, below_action of a folder of YAML policies: one row for each rule.
    A policy's version is the hash of its file; of several files of one policy_id the last by name wins.

    The files are read by Spark, whatever the store; policies are a few small documents, which the driver parses."""
    import yaml

    texts = spark.read.text(f"{folder.rstrip('/')}/*.yaml", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value", F.concat(F.lit("sha256:"), F.sha2(F.col("value").cast("binary"), 256)).alias("version"))
    latest: dict[str, list[tuple]] = {}
    for file in texts.orderBy("name").collect():
        document = yaml.safe_load(file["value"]) or {}
        if "policy_id" not in document or not isinstance(document.get("rules"), dict):
            raise ValueError(f"invalid policy {file['name']}")
        rules = {label: (r.get("action"), r.get("min_confidence"), r.get("below_min_action")) for label, r in document["rules"].items()}
        validate(rules)
        latest[document["policy_id"]] = [(document["policy_id"], file["version"], label, *rule) for label, rule in rules.items()]
    return spark.createDataFrame([row for rows in latest.values() for row in rows], "policy_id string, version string, label string, action string, min_confidence double, below_action string")


def write_policies(spark: SparkSession, folder: str, policies: dict[str, dict[str, tuple]] | None = None) -> None:
    """One YAML file for each policy, through Spark's file system."""
    import yaml

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, rules in (policies or fixed.POLICIES).items():
        shown = {label: {"action": a, "min_confidence": m, "below_min_action": b} for label, (a, m, b) in rules.items()}
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.yaml"))
        out.write(bytearray(yaml.safe_dump({"policy_id": name, "rules": shown}).encode()))
        out.close()
