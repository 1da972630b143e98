"""The registered queries over the smallest tables, against their SQL where there is some."""

import os

import duckdb
import pytest

from veilspan.llm import registry

DATA = os.environ.get("VEILSPAN_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is absent")


def test_every_operator_has_one_query():
    names = [n for n in registry.queries() if n != "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert all(isinstance(sql, str) for sql in registry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    found = registry.queries()[name](spark, DATA)
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    wanted = connection.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, connection.sql(f"select {', '.join(columns)} from wanted").fetchall()))
