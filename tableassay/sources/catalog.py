"""What a database holds: its tables, columns, row counts and first rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableassay.functions.schema import quoted, text, union_all
from tableassay.sources import sqlite

Database = str | Mapping[str, DataFrame] | None


def tables_of(spark: SparkSession, database: Database = None) -> dict[str, DataFrame]:
    """Tables by name: of a SQLite path, of a mapping, or of the session catalog."""
    if database is None:
        return {t.name: spark.table(quoted(t.name)) for t in spark.catalog.listTables()}
    if isinstance(database, str):
        return {t: sqlite.read_sqlite_table(spark, database, t) for t in sqlite.list_tables(database)}
    return dict(database)


def explore_database(spark: SparkSession, database: Database = None) -> DataFrame:
    """``(table, column, type, rows)``, one row per column; one count per table."""
    tables = tables_of(spark, database)
    if not tables:
        return spark.createDataFrame([], "table string, column string, type string, rows bigint")
    parts = []
    for name, df in tables.items():
        if isinstance(database, str):
            types = [(n, d) for n, d in sqlite.declared_columns(database, name)]
        else:
            types = df.dtypes
        entries = ", ".join(f"struct({text(n)} AS column, {text(t)} AS type)" for n, t in types)
        parts.append(
            df.agg(F.expr("count(1) AS rows")).selectExpr(
                f"{text(name)} AS table", f"inline(array({entries}))", "rows"
            )
        )
    return union_all(parts)


def sample_rows(spark: SparkSession, database: Database, table: str, order_by: str | list[str], k: int = 3) -> DataFrame:
    """The first ``k`` rows of a table by an explicit key."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    return tables_of(spark, database)[table].orderBy(*[F.col(quoted(c)) for c in keys]).limit(k)
