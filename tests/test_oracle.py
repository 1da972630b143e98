"""Every query with oracle SQL gives the oracle's rows on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

from veilspan.plans import registry

DATA = os.environ.get("VEILSPAN_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list:
    def plain(value):
        if value is None or pd.isna(value):
            return "null"
        return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    found, wanted = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    registry.queries()[name](spark, DATA).toPandas()


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
