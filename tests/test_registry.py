"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as registry
from kategora.checks.oracles import sql
from kategora.checks.queries import registered

FOLDER = "/root/testdata/sf0.001"
QUERIES = registered()
SQL = sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"fit_dense", "dense_search"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows, _, _ = compare(spark, QUERIES[name], SQL.get(name), FOLDER, con)
    assert problem is None and rows > 0


def test_entry(spark):
    assert registry.entry(spark).count() == 40
