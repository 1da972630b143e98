"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two joins on a node and one distinct; nothing is gathered in a task or on the driver but
a row count and a checksum that tell when the edges stop changing. A hub's edges can be split by
adaptive skew joins, since each step meets its edges in an ordinary equi-join. Edge tables of up to FEW rows, which
are counted first, take their steps in one task each, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common


#: Edges (16 bytes each) that one task takes.
FEW = 1 << 15


def _large_star(edges: DataFrame, dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = dealt(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    across = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return dealt(across.unionByName(least.select("a", F.col("m").alias("b")))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its own root; `edges` has long columns a and b, in any
    order and with repeats; the root is a component's smallest node."""
    few = edges.count() <= FEW
    dealt = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    state = dealt(edges.where("a <> b").select("a", "b")).distinct()
    before = None
    while True:
        last, state = state, common.materialize(_small_star(_large_star(dealt(state), dealt), dealt), "stars")
        if before is not None:
            common.discard(last)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            found = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found.scratch_path = state.scratch_path
            return found
        before = now
