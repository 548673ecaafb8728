"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest
from check_queries import compare, connect

import __spark_entry__ as entry_points
from tests_data import SMALL

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def sql() -> duckdb.DuckDBPyConnection:
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    result = sql.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert compare(rows, df.columns, result.fetchall(), columns) == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
