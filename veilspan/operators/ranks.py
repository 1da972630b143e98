"""Exact values at ranks of a table, group by group, without sorting a group.

The wanted rank is bracketed: a mergeable sketch of the values between two bounds gives splitters at equal shares of
them, exact counts between the splitters tell where the rank lies, and so a bracket holds about a sixty-fourth of
its values after a round, however the values are spread. Brackets of few values are ranked; one of a single value is
the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import scratch

#: Values of a bracket that are ranked, parts of a wider one, and the sketch's accuracy.
FEW, PARTS, ACCURACY = 1 << 16, 64, 10_000


def _within(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """The values of each bracket, with it."""
    named = brackets.withColumnRenamed("g", "of")
    return values.join(named, F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high"))).drop("of")


def _narrowed(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """Each bracket's part that holds its rank."""
    inside = _within(values, brackets)
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    splits = inside.groupBy("g", "name").agg(F.percentile_approx("v", shares, ACCURACY).alias("splits")).withColumnsRenamed({"g": "sg", "name": "sname"})
    part = F.size(F.filter("splits", lambda s: s < F.col("v")))
    dealt = inside.join(splits, F.col("g").eqNullSafe(F.col("sg")) & (F.col("name") == F.col("sname"))).withColumn("part", part)
    counted = dealt.groupBy("g", "name", "part").agg(F.first("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    before = F.sum("n").over(Window.partitionBy("g", "name").orderBy("part")) - F.col("n")  # PARTS rows
    found = counted.withColumn("before", before).where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
    return found.select("g", "name", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high")


def at_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float], few: int = FEW) -> DataFrame:
    """group, name, found: of each group and share the value sorted[int(n * share)] (the last for a share of 1). Null
    values take no part; groups without values are left out. Null is a group."""
    values = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    ends = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("share")) for n, p in shares.items()])).alias("w")
    rank = F.least(F.floor(F.col("n") * F.col("w.share")) + 1, "n").alias("rank")
    brackets = scratch(ends.select("g", wanted, "n", "low", "high").select("g", "w.name", rank, "n", "low", "high"), "brackets")
    wide = (F.col("n") > few) & (F.col("low") < F.col("high"))
    while not brackets.where(wide).isEmpty():
        brackets = scratch(_narrowed(values, brackets.where(wide)).unionByName(brackets.where(~wide)), "brackets")
    single = F.col("low") == F.col("high")
    ranked = _within(values, brackets.where(~single)).withColumn("place", F.row_number().over(Window.partitionBy("g", "name").orderBy("v")))
    found = ranked.where(F.col("place") == F.col("rank")).select("g", "name", "v").unionByName(brackets.where(single).select("g", "name", F.col("low").alias("v")))
    return found.select(F.col("g").alias(group), "name", F.col("v").alias("found"))
