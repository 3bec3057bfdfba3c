"""The registered queries against their SQL on small tables."""

import pytest
from oracle import assert_equal, tables

from vantage.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, base, name):
    assert_equal(spark, base, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
