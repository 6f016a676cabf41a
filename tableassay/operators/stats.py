"""Column profile: types, missing cells, distinct values, moments."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableassay.functions.schema import (
    as_double,
    column_class,
    empty,
    flat_columns,
    has_value,
    number,
    numeric_columns,
    quoted,
    text,
    union_all,
)
from tableassay.functions.shape import inline_columns, long_numbers, with_names
from tableassay.functions.values import CELL, DIGEST, cell, identity
from tableassay.operators.quantiles import QUARTERS, Ranges, approx_quantiles, brackets, exact_quantiles

MOMENTS = (
    "column string, n bigint, mean double, min double, max double, "
    "m2 double, m3 double, m4 double"
)

# Bytes of one value, by type; text and binary are measured instead.
_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.DateType: 4,
    T.FloatType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def column_types(df: DataFrame) -> DataFrame:
    """``(column, dtype, class)`` from the schema; no job."""
    rows = [(f.name, f.dataType.simpleString(), column_class(f.dataType)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, class string")


def class_counts(df: DataFrame) -> DataFrame:
    """Number of columns per class."""
    return column_types(df).groupBy("class").agg(F.count(F.lit(1)).alias("columns"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def _sizes(df: DataFrame) -> list[str]:
    """SQL of the logical size of each column."""
    sizes = []
    for f in df.schema.fields:
        width = _WIDTHS.get(type(f.dataType))
        if width:
            sql = f"count({quoted(f.name)}) * {width}"
        elif isinstance(f.dataType, T.DecimalType):
            sql = f"count({quoted(f.name)}) * {8 if f.dataType.precision <= 18 else 16}"
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sql = f"coalesce(sum(octet_length({quoted(f.name)})), 0)"
        else:
            sql = f"coalesce(sum(octet_length(to_json(struct({quoted(f.name)})))), 0)"
        sizes.append(f"CAST({sql} AS BIGINT)")
    return sizes


def column_footprint(df: DataFrame) -> DataFrame:
    """``(column, bytes)``: logical size of the data, not of its storage."""
    sizes = _sizes(df)
    row = df.agg(*[F.expr(f"{s} AS b{i}") for i, s in enumerate(sizes)])
    return inline_columns(row, df.columns, {"bytes": [f"b{i}" for i in range(len(sizes))]})


def missing_summary(df: DataFrame) -> DataFrame:
    """``(column, missing, missing_pct)`` of every column, most missing first."""
    row = df.agg(
        F.expr("count(1) AS total"),
        *[F.expr(f"count_if({has_value(df, n)}) AS n{i}") for i, n in enumerate(df.columns)],
    )
    out = inline_columns(
        row,
        df.columns,
        {
            "missing": [f"total - n{i}" for i in range(len(df.columns))],
            "missing_pct": [f"try_divide((total - n{i}) * 100.0D, total)" for i in range(len(df.columns))],
        },
    )
    return out.orderBy(F.desc("missing_pct"), "column")


def missing_nonzero(df: DataFrame) -> DataFrame:
    """``(column, missing)`` of the columns with gaps, most missing first."""
    return (
        missing_summary(df).where("missing > 0").select("column", "missing").orderBy(F.desc("missing"), "column")
    )


def distinct_counts(df: DataFrame, names: list[str] | None = None, exact: bool = True) -> DataFrame:
    """``(column, distinct)`` over non-missing values, most distinct first.

    Exact counts take one scan: cells become (column, 128-bit digest), equal ones combine
    in a hash table of fixed width before the shuffle, and digests are counted.
    """
    names = flat_columns(df) if names is None else names
    if not names:
        return empty(df, "column string, distinct bigint")
    if exact:
        cells = ", ".join(f"{i}, {cell(df, n)}" for i, n in enumerate(names))
        values = df.selectExpr(f"stack({len(names)}, {cells}) AS (idx, {CELL})").selectExpr("idx", *DIGEST).distinct()
        # a missing cell is a group that does not count, so that every column has a row
        found = values.groupBy("idx").agg(F.expr("count(h1) AS distinct"))
        every = df.sparkSession.range(len(names), numPartitions=1).selectExpr("CAST(id AS INT) AS idx")
        out = with_names(every.join(F.broadcast(found), "idx", "left").selectExpr("idx", "coalesce(distinct, 0L) AS distinct"), names)
    else:
        row = df.agg(*[F.expr(f"approx_count_distinct({identity(df, n)}) AS d{i}") for i, n in enumerate(names)])
        out = inline_columns(row, names, {"distinct": [f"d{i}" for i in range(len(names))]})
    return out.orderBy(F.desc("distinct"), "column")


def column_means(df: DataFrame, names: list[str]):
    """Scalar array of the column means, for centring in a second scan."""
    return df.agg(F.expr(f"array({', '.join(f'avg({as_double(df, n)})' for n in names)}) AS m")).scalar()


def moments(df: DataFrame, names: list[str] | None = None, centres: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, range and central moment sums of numeric columns.

    Two scans: the means, then plain sums of powers of the centred values.
    Sums are cheaper than the built-in moment aggregates, which divide at every
    row, and centring first keeps their precision.  Known ``centres`` near the
    medians save the first scan: a median is within one standard deviation of
    the mean, which is near enough.
    """
    names = numeric_columns(df) if names is None else names
    if not names:
        return empty(df, MOMENTS)
    if centres is None:
        centre = F.get(column_means(df, names), F.col("idx"))
    else:
        centre = F.expr(f"get(array({', '.join(number(centres.get(n, 0.0)) for n in names)}), idx)")
    rows = long_numbers(df, names).withColumn("m", centre).selectExpr("idx", "value", "m", "value - m AS d")
    sums = rows.groupBy("idx").agg(
        F.expr("count(value) AS n"),
        F.expr("max(m) AS m"),
        F.expr("min(value) AS min"),
        F.expr("max(value) AS max"),
        F.expr("sum(d) AS s1"),
        F.expr("sum(d * d) AS s2"),
        F.expr("sum(d * d * d) AS s3"),
        F.expr("sum(d * d * d * d) AS s4"),
    )
    # the centre is off the mean by e = s1 / n
    centred = sums.selectExpr("*", "try_divide(s1, n) AS e").selectExpr(
        "idx",
        "n",
        "m + e AS mean",
        "min",
        "max",
        "IF(min = max, 0D, s2 - n * e * e) AS m2",
        "IF(min = max, 0D, s3 - 3 * e * s2 + 2 * n * e * e * e) AS m3",
        "IF(min = max, 0D, s4 - 4 * e * s3 + 6 * e * e * s2 - 3 * n * e * e * e * e) AS m4",
    )
    return with_names(_all_slots(df, names, centred), names)


def _all_slots(df: DataFrame, names: list[str], found: DataFrame) -> DataFrame:
    """One row per column position, also for an empty table."""
    slots = df.sparkSession.range(len(names), numPartitions=1).selectExpr("CAST(id AS INT) AS idx")
    rest = [f"coalesce({c}, 0) AS {c}" if c == "n" else c for c in found.columns]
    return slots.join(F.broadcast(found), "idx", "left").selectExpr(*rest)


# Sample forms over the central moment sums, as pandas defines them.
VARIANCE = "IF(n > 1, m2 / (n - 1), NULL)"
STD = "IF(n > 1, sqrt(m2 / (n - 1)), NULL)"
SKEW = (
    "CASE WHEN n < 3 THEN NULL WHEN m2 = 0 THEN 0D "
    "ELSE n * sqrt(n - 1) / (n - 2) * m3 / (m2 * sqrt(m2)) END"
)
KURTOSIS = (
    "CASE WHEN n < 4 THEN NULL WHEN m2 = 0 THEN 0D "
    "ELSE (n - 1D) / ((n - 2D) * (n - 3D)) * ((n + 1D) * (n * m4 / (m2 * m2) - 3D) + 6D) END"
)


def _stat(df: DataFrame, names: list[str] | None, name: str, sql: str) -> DataFrame:
    return moments(df, names).selectExpr("column", f"{sql} AS {name}")


def skewness(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return _stat(df, names, "skewness", SKEW)


def kurtosis(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return _stat(df, names, "kurtosis", KURTOSIS)


def variance(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return _stat(df, names, "variance", VARIANCE)


# The statistics that ``describe`` lists, and the further ones.
DESCRIBE = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
MORE = ("skewness", "kurtosis", "variance")

_FROM_MOMENTS = {
    "count": "CAST(n AS DOUBLE)",
    "mean": "mean",
    "std": STD,
    "min": "min",
    "max": "max",
    "skewness": SKEW,
    "kurtosis": KURTOSIS,
    "variance": VARIANCE,
}


def _stat_rows(df, names, wanted, exact, ranges) -> DataFrame:
    names = numeric_columns(df) if names is None else names
    if not names:
        return empty(df, "column string, stat string, value double")
    entries = ", ".join(f"named_struct('stat', '{s}', 'value', {_FROM_MOMENTS[s]})" for s in wanted if s in _FROM_MOMENTS)
    centres = None
    if exact:
        ranges = brackets(df, names, QUARTERS) if ranges is None else ranges
        quarters = exact_quantiles(df, names, QUARTERS, ranges)
        middle = {n: sum(ranges[n].ends[QUARTERS.index(0.5)]) / 2 for n in names if n in ranges}
        centres = {n: m for n, m in middle.items() if isfinite(m)}
    else:
        quarters = approx_quantiles(df, names, QUARTERS)
    return (
        moments(df, names, centres)
        .selectExpr("column", f"inline(array({entries}))")
        .unionByName(quarters.selectExpr("column", "concat(CAST(prob * 100 AS INT), '%') AS stat", "value"))
    )


def describe(df: DataFrame, names: list[str] | None = None, exact: bool = True, ranges: Ranges | None = None) -> DataFrame:
    """``(column, stat, value)``: count, mean, std, min, quartiles, max."""
    return _stat_rows(df, names, DESCRIBE, exact, ranges)


def statistical_summary(
    df: DataFrame, names: list[str] | None = None, exact: bool = True, ranges: Ranges | None = None
) -> DataFrame:
    """``describe`` plus skewness, kurtosis and variance."""
    return _stat_rows(df, names, DESCRIBE + MORE, exact, ranges)


def basic_info(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(column, dtype, class, rows, missing, missing_pct, distinct, bytes)``.

    Nested columns have no distinct count.  One scan for those, one for the rest.
    """
    row = df.agg(
        F.expr("count(1) AS total"),
        *[F.expr(f"count_if({has_value(df, n)}) AS n{i}") for i, n in enumerate(df.columns)],
        *[F.expr(f"{s} AS b{i}") for i, s in enumerate(_sizes(df))],
    )
    at = range(len(df.columns))
    cells = {
        "rows": ["total" for _ in at],
        "missing": [f"total - n{i}" for i in at],
        "missing_pct": [f"try_divide((total - n{i}) * 100.0D, total)" for i in at],
        "bytes": [f"b{i}" for i in at],
    }
    info = column_types(df)
    # one row per column on every side
    for part in (inline_columns(row, df.columns, cells), distinct_counts(df, exact=exact)):
        info = info.join(F.broadcast(part), "column", "left")
    return info.select(
        "column", "dtype", "class", "rows", "missing", "missing_pct", "distinct", "bytes"
    )
