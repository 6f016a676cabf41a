"""Column classes and SQL names, read from the schema alone (no job).

Operators over many columns build their expressions as SQL text: one call into
the JVM per expression, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, DATETIME = "numeric", "categorical", "datetime"
BOOLEAN, NESTED, OTHER = "boolean", "nested", "other"


def column_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return NESTED
    return OTHER


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if column_class(f.dataType) in classes]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of(df, CATEGORICAL)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, DATETIME)


def flat_columns(df: DataFrame) -> list[str]:
    """All columns whose values can be compared and grouped."""
    return [f.name for f in df.schema.fields if column_class(f.dataType) != NESTED]


def quoted(name: str) -> str:
    """The exact column name as SQL, also when it holds dots or spaces."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    """A SQL double literal that reads back as the same number."""
    if value != value or value in (float("inf"), float("-inf")):
        return f"CAST('{value}' AS DOUBLE)"
    return f"{float(value)!r}D"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> str:
    """SQL of the column with NaN read as missing; other types are left as they are."""
    return f"nanvl({quoted(name)}, NULL)" if is_float(df, name) else quoted(name)


def as_double(df: DataFrame, name: str) -> str:
    return f"CAST({present(df, name)} AS DOUBLE)"


def as_finite(df: DataFrame, name: str) -> str:
    """``as_double`` with infinities read as missing, for ranges and moments over a range."""
    sql = as_double(df, name)
    return f"IF(abs({sql}) < double('Infinity'), {sql}, NULL)" if is_float(df, name) else sql


def has_value(df: DataFrame, name: str) -> str:
    """SQL condition for a non-missing cell; its first part reaches the scan."""
    test = f"{quoted(name)} IS NOT NULL"
    return f"{test} AND NOT isnan({quoted(name)})" if is_float(df, name) else test


def texts(values: Iterable[str]) -> str:
    return "array(" + ", ".join(text(v) for v in values) + ")"


def empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
