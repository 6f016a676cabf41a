"""SQL over registered sources."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tableassay.functions.schema import quoted


@contextmanager
def registered(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Iterator[None]:
    """The tables as temporary views; views of the same names are put back after."""
    earlier = {}
    for name, df in tables.items():
        view = quoted(name)
        if spark.catalog.tableExists(view) and spark.catalog.getTable(view).isTemporary:
            earlier[name] = spark.table(view)
        df.createOrReplaceTempView(view)
    try:
        yield
    finally:
        for name in tables:
            if name in earlier:
                earlier[name].createOrReplaceTempView(quoted(name))
            else:
                spark.catalog.dropTempView(name)


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run a query over the given tables and the session's own views.

    The result is bound to the tables when it is built, so it outlives the views.
    """
    if not tables:
        return spark.sql(query)
    with registered(spark, tables):
        return spark.sql(query)


def scan(df: DataFrame) -> DataFrame:
    return df.select("*")


def count_rows(df: DataFrame) -> DataFrame:
    return df.selectExpr("count(*) AS rows")
