"""Every query with checking SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from tools.check import TABLES, rows_of
from vigilflow.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# The slowest ones run in tools/check.py only.
SLOW = {"T5_suppression_split_keys", "S10_version_dispatch"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, result.fetchall())


def test_every_checked_query_is_registered():
    assert set(ORACLES) <= set(QUERIES)
