"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

from factloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_duckdb(spark, same_as_duckdb, name):
    same_as_duckdb(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["status", "customers"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
