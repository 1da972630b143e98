"""Registry of the governance queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
PLANS = ("detection", "governance", "control", "streams", "planted", "evaluation")


def _plans():
    return [import_module(f"veilspan.plans.{name}") for name in PLANS]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["findings_by_action"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: function for plan in _plans() for name, function in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _plans() for name, sql in plan.SQL.items()}
