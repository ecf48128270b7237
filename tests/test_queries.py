"""Every registered query with SQL gives the same rows as DuckDB, and every other one runs."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, SF, QUERIES[name], SQL[name], con) == ""
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_registered_queries_only():
    assert set(SQL) <= set(QUERIES)
