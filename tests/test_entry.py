"""Every core query against its SQL on the smallest tables."""

import pytest
from oracle import differences

from weftline.plans import core_queries, tree_queries

QUERIES = core_queries.QUERIES | tree_queries.QUERIES
SQL = core_queries.SQL | tree_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, QUERIES, SQL, name) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
