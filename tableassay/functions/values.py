"""Value-level tests and keys, as SQL text over JVM-side functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableassay.functions.schema import NESTED, as_double, column_class, present, quoted

# Lengths and separators by which a text counts as a date.
DATE_LENGTHS = (8, 10, 19)
DATE_SEPARATORS = "[-/:]"

# Texts longer than this are compared by digest, so a shuffle never carries them.
LONG_TEXT = 64

_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def looks_like_date(sql: str) -> str:
    lengths = ", ".join(str(n) for n in DATE_LENGTHS)
    return f"(length({sql}) IN ({lengths}) AND {sql} RLIKE '{DATE_SEPARATORS}')"


def is_number_text(sql: str) -> str:
    """True where the text reads as a number (no type suffix, no NaN)."""
    return f"({sql} RLIKE r'{_NUMBER}')"


def canonical(sql: str, dtype: T.DataType) -> str:
    """A value whose JSON form is equal exactly where the value is equal: map entries in
    order of their keys, at any depth; a VARIANT as its own JSON text, keys sorted."""
    if isinstance(dtype, T.VariantType):
        return f"to_json({sql})"
    if isinstance(dtype, T.ArrayType):
        return f"transform({sql}, e -> {canonical('e', dtype.elementType)})" if _unordered(dtype.elementType) else sql
    if isinstance(dtype, T.MapType):
        ordered = f"array_sort(map_entries({sql}), (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)"
        return f"transform({ordered}, e -> struct(e.key AS k, {canonical('e.value', dtype.valueType)} AS v))"
    if isinstance(dtype, T.StructType) and _unordered(dtype):
        fields = ", ".join(f"{canonical(f'{sql}.{quoted(f.name)}', f.dataType)} AS {quoted(f.name)}" for f in dtype.fields)
        return f"IF({sql} IS NULL, NULL, struct({fields}))"
    return sql


def _unordered(dtype: T.DataType) -> bool:
    """Whether the type holds a map or a VARIANT."""
    if isinstance(dtype, T.ArrayType):
        return _unordered(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_unordered(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def cell(df: DataFrame, name: str) -> str:
    """The value as three columns of which its type fills one: whole numbers, doubles, texts.

    Short code per column, so that a table of many columns still compiles; ``DIGEST``
    hashes afterwards."""
    dtype, raw = df.schema[name].dataType, quoted(name)
    whole, double, characters = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        double = as_double(df, name)
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        whole = f"CAST({raw} AS BIGINT)"
    elif isinstance(dtype, T.DateType):
        whole = f"CAST(unix_date({raw}) AS BIGINT)"
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = f"IF({raw} IS NULL, NULL, xxhash64({raw}))"  # one to one
    elif column_class(dtype) == NESTED or _unordered(dtype):
        characters = f"IF({raw} IS NULL, NULL, to_json(struct({canonical(raw, dtype)} AS v), map('ignoreNullFields', 'false')))"
    else:
        characters = f"CAST({raw} AS STRING)"
    return f"{whole}, {double}, {characters}"


#: Two 64-bit hashes of a cell, equal together exactly where cells are equal; a whole number
#: stands for itself, and xxhash64 of a double is one to one.  NULL where it is missing.
CELL = "whole, double, characters"
DIGEST = (
    "coalesce(whole, IF(double IS NOT NULL, xxhash64(double + 0), IF(characters IS NULL, NULL, xxhash64(characters)))) AS h1",
    "IF(characters IS NULL, 0L, xxhash64('second', characters)) AS h2",
)


def top_key(df: DataFrame, name: str) -> str:
    """A text that stands for a value in counts and orders like it: a short one whole, of a
    long one its first characters and a digest."""
    raw = f"CAST({present(df, name)} AS STRING)"
    return f"IF(length({raw}) > {LONG_TEXT}, concat('#', left({raw}, {LONG_TEXT}), sha2(CAST({raw} AS BINARY), 256)), concat('=', {raw}))"


def identity(df: DataFrame, name: str) -> str:
    """A value that is equal exactly where the column is equal.

    Short texts stand for themselves; long ones become length plus SHA-256, so
    grouping by a column of whole documents shuffles about 70 bytes a row.
    """
    raw = quoted(name)
    if isinstance(df.schema[name].dataType, T.VariantType):
        return f"sha2(to_json({raw}), 256)"
    if isinstance(df.schema[name].dataType, T.StringType):
        return (
            f"CASE WHEN octet_length({raw}) > {LONG_TEXT} "
            f"THEN concat('#', octet_length({raw}), ':', sha2(CAST({raw} AS BINARY), 256)) "
            f"ELSE concat('=', {raw}) END"
        )
    return present(df, name)


def identity_text(df: DataFrame, name: str) -> str:
    """``identity`` as text, NULL where the cell is missing."""
    return f"CAST({identity(df, name) if not isinstance(df.schema[name].dataType, T.StringType) else quoted(name)} AS STRING)"
