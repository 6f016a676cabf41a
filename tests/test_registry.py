"""Every registered query against its SQL, and the plans of all of them."""

import pytest

import __spark_entry__ as entry
import workload.oracle
import workload.queries
from workload.check import compare, connect

QUERIES, STATEMENTS = workload.queries.queries(), workload.oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry.queries()) and set(STATEMENTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare(df, con, STATEMENTS[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_compare_sees_differences(spark, con):
    df = spark.sql("SELECT 1L AS n, 2.0D AS v")
    assert compare(df, con, "SELECT 1::BIGINT AS n, 2.0::DOUBLE AS v") is None
    assert compare(df, con, "SELECT 1::BIGINT AS n, 2.5::DOUBLE AS v") is not None
    assert compare(df, con, "SELECT 1::BIGINT AS n") is not None
    assert compare(df, con, "SELECT 1::BIGINT AS n, 2.0::DOUBLE AS v WHERE false") is not None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["section", "column", "metric", "value"]
    assert df.count() > 100
