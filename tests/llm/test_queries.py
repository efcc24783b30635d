"""Queries of this subpackage against their SQL, or running over whole tables."""

import importlib

import pytest
from oracle import differences

from weftline.llm import MODULES

FOUND = [importlib.import_module(m) for m in MODULES]
QUERIES = {k: f for m in FOUND for k, f in m.QUERIES.items()}
SQL = {k: s for m in FOUND for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, QUERIES, SQL, name) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_columns():
    assert {"p2_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_mix", "p9_found"} <= set(QUERIES)
