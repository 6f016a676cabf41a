"""Calendar views of datetime columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableassay.functions.schema import datetime_columns, empty, quoted, text
from tableassay.functions.shape import inline_columns


def date_range(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column, first, last, seconds)`` of each datetime column."""
    names = datetime_columns(df) if names is None else names
    if not names:
        return empty(df, "column string, first timestamp_ntz, last timestamp_ntz, seconds bigint")
    row = df.agg(
        *[
            F.expr(f"{f}(CAST({quoted(n)} AS TIMESTAMP_NTZ)) AS {f}{i}")
            for i, n in enumerate(names)
            for f in ("min", "max")
        ]
    )
    at = range(len(names))
    return inline_columns(
        row,
        names,
        {
            "first": [f"min{i}" for i in at],
            "last": [f"max{i}" for i in at],
            "seconds": [f"timestampdiff(SECOND, min{i}, max{i})" for i in at],
        },
    )


def calendar_features(df: DataFrame, name: str) -> DataFrame:
    """The table with year, month, day, dayofweek (Monday 0) and hour columns added."""
    c = quoted(name)
    has_hours = not isinstance(df.schema[name].dataType, T.DateType)
    return df.withColumns(
        {
            f"{name}_year": F.expr(f"year({c})"),
            f"{name}_month": F.expr(f"month({c})"),
            f"{name}_day": F.expr(f"dayofmonth({c})"),
            f"{name}_dayofweek": F.expr(f"weekday({c})"),
            f"{name}_hour": F.expr(f"hour({c})" if has_hours else "CAST(NULL AS INT)"),
        }
    )


def _counts(df: DataFrame, names: list[str] | None, label: str, sql: str, dtype: str) -> DataFrame:
    """``(column, label, rows)`` per calendar unit, over all datetime columns in one scan."""
    names = datetime_columns(df) if names is None else names
    if not names:
        return empty(df, f"column string, {label} {dtype}, rows bigint")
    cells = ", ".join(f"{text(n)}, CAST({quoted(n)} AS TIMESTAMP_NTZ)" for n in names)
    return (
        df.selectExpr(f"stack({len(names)}, {cells}) AS (column, ts)")
        .where("ts IS NOT NULL")
        .groupBy("column", F.expr(f"{sql} AS {label}"))
        .agg(F.expr("count(1) AS rows"))
        .orderBy("column", label)
    )


def daily_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return _counts(df, names, "day", "to_date(ts)", "date")


def monthly_pattern(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows per month of the year, all years together."""
    return _counts(df, names, "month", "month(ts)", "int")


def weekday_pattern(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows per day of the week, Monday 0."""
    return _counts(df, names, "dayofweek", "weekday(ts)", "int")


def hourly_pattern(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows per hour; plain dates have none."""
    names = datetime_columns(df) if names is None else names
    timed = [n for n in names if not isinstance(df.schema[n].dataType, T.DateType)]
    return _counts(df, timed, "hour", "hour(ts)", "int")
