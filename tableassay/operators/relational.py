"""Projection, filter, order and limit on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableassay.functions.schema import col, has_value


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[col(n) for n in names])


def filter_predicate(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def filter_result(result: DataFrame, metric: str, above: float) -> DataFrame:
    """Rows of a result table whose metric is above a limit."""
    return result.where(col(metric) > F.lit(above))


def drop_nulls(df: DataFrame, name: str) -> DataFrame:
    return df.where(has_value(df, name))


def head(df: DataFrame, order_by: str | list[str], k: int = 5) -> DataFrame:
    """The first ``k`` rows by an explicit key: a top-k per task, then one merge."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*[col(n) for n in keys]).limit(k)


def sort_values(
    df: DataFrame, by: str, descending: bool = True, absolute: bool = False, tie: list[str] | None = None
) -> DataFrame:
    key = F.abs(col(by)) if absolute else col(by)
    return df.orderBy(key.desc() if descending else key.asc(), *[col(n) for n in tie or []])


def add_columns(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})
