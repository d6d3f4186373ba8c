"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_queries_and_sql_go_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) - len(sql) <= 10


@pytest.mark.skipif(not os.path.isdir(entry.SMALL), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["t", "click", "error", "purchase", "signup", "view"] and df.count() == 120
