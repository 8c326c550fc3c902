"""Every query with a SQL counterpart agrees with it."""

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lodestat.registry import forecasting, properties

FOLDER = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


@pytest.mark.parametrize("wrong", ["residual * 1.01", "IF(day(ts) = 15, residual + 0.01, residual)"])
def test_wrong_residuals_are_noticed(spark, duck, wrong):
    rows = forecasting.ENTRIES["m6_residuals"][0](spark, FOLDER).withColumn("residual", F.expr(wrong))
    assert compare(properties._recursion(rows, spark, FOLDER), duck, SQL["m6_residuals"]) is not None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 4
