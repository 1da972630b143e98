"""Evaluation corpora and models: templates filled by seeded draws, exact TF-IDF, confusion counts and recall.

Nothing of a corpus but counts comes to the driver: draws are hashes of seed and number, the vocabulary is a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(seed: int, name: str, draw: Column, among: Column | int) -> Column:
    """A number from 0 up to `among`, drawn by seed, name and number of the draw: the first eight hex digits of a hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(name), draw.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % among


def sampled(draws: DataFrame, draw: str, templates: list[str], slots: dict[str, list[str]], seed: int) -> DataFrame:
    """draw, text: templates with `{slot}` fields filled by values that each draw picks; of equal texts the first draw stays.
    Templates and values are short lists of a corpus' author; draws are a table of any size."""
    pick = lambda name, values: F.element_at(F.array(*[F.lit(v) for v in values]), (drawn(seed, name, F.col(draw), len(values)) + 1).cast("int"))
    text = pick("template", templates)
    for name, values in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), pick(name, values))
    return draws.select(text.alias("text"), F.col(draw).alias("draw")).groupBy("text").agg(F.min("draw").alias("draw")).select("draw", "text")


def terms(text: Column) -> Column:
    """Words of two characters or more in lower case, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def tfidf(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, df, weight: exact TF-IDF with smooth idf, each text's weights of length 1. The vocabulary is a table of
    document frequencies; a frequent term's rows are added up in each task before they meet. Texts without terms, and
    null texts, have no rows but count as texts; repeated rows of a key are one text."""
    counts = texts.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = texts.select(key).distinct().agg(F.count(F.lit(1)).alias("texts"))
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).withColumn("idf", F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).drop("texts")
    weighted = counts.join(frequency.hint("merge"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "tf", "df", (F.col("w") / length).alias("weight"))


def injection_model(labelled: DataFrame, text: str = "text", label: str = "label"):
    """A pipeline of exact term counts, idf and logistic regression, fitted on labelled texts (1: an attack)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, SQLTransformer

    cut = r"filter(split(lower({0}), '\\W+'), w -> length(w) > 1)".format(text)
    words = SQLTransformer(statement=f"SELECT *, concat({cut}, transform(sequence(1, greatest(size({cut}) - 1, 1)), i -> concat_ws(' ', slice({cut}, i, 2)))) AS terms_ FROM __THIS__")
    stages = [words, CountVectorizer(inputCol="terms_", outputCol="tf_", vocabSize=1 << 18), IDF(inputCol="tf_", outputCol="idf_"), LogisticRegression(featuresCol="idf_", labelCol=label, maxIter=50, regParam=0.01)]
    return Pipeline(stages=stages).fit(labelled)


def confusion(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, tp, fp, fn, precision, recall (6 places) of each class that occurs as a label or a prediction."""
    pairs = scored.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    right = F.col("l").eqNullSafe(F.col("p"))
    true = pairs.where(F.col("l").isNotNull()).groupBy(F.col("l").alias("class")).agg(F.sum(F.when(right, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~right, F.col("n")).otherwise(0)).alias("fn"))
    false = pairs.where(F.col("p").isNotNull() & ~right).groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("fp"))
    both = true.join(false, "class", "full").na.fill(0, ["tp", "fp", "fn"])
    share = lambda over: F.when(F.col("tp") + F.col(over) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(over)), 6)).otherwise(0.0)
    return both.select("class", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))
