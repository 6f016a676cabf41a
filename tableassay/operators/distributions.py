"""The tables behind distribution plots."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableassay.functions.schema import (
    BOOLEAN,
    CATEGORICAL,
    as_double,
    as_finite,
    columns_of,
    empty,
    has_value,
    numeric_columns,
    present,
    quoted,
    text,
)
from tableassay.functions.shape import long_numbers, with_names
from tableassay.functions.values import top_key
from tableassay.operators.quantiles import Ranges, fences

HISTOGRAM = "column string, bin int, lower double, upper double, count bigint, density double"
# exp(-z * z / 2) is exactly zero in double precision beyond this z
KERNEL_REACH = 39
# cells per bandwidth, and terms of a cell's series: |z t| is at most 39 / 16
KERNEL_CELLS = 8
KERNEL_TERMS = 20


def null_pattern(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(missing_columns, rows)``: which columns are missing together."""
    names = df.columns if names is None else names
    flags = ", ".join(f"IF({has_value(df, n)}, NULL, {text(n)})" for n in names)
    return (
        df.groupBy(F.expr(f"concat_ws(',', {flags}) AS missing_columns"))
        .agg(F.expr("count(1) AS rows"))
        .orderBy(F.desc("rows"), "missing_columns")
    )


def null_blocks(df: DataFrame, key: str, names: list[str] | None = None, blocks: int = 50) -> DataFrame:
    """``(block, column, rows, missing, missing_pct)`` over equal ranges of a numeric key."""
    names = [n for n in df.columns if n != key] if names is None else names
    k = as_double(df, key)
    bounds = df.agg(F.expr(f"struct(min({k}) AS lo, max({k}) AS hi) AS b")).scalar()
    block = F.expr(
        f"CAST(least(coalesce(floor(try_divide({k} - _b.lo, _b.hi - _b.lo) * {blocks}), 0), {blocks - 1}) AS INT)"
    )
    flagged = df.withColumn("_b", bounds).select(
        block.alias("block"),
        F.expr(
            "stack({}, {}) AS (idx, gap)".format(
                len(names), ", ".join(f"{i}, IF({has_value(df, n)}, 0, 1)" for i, n in enumerate(names))
            )
        ),
    )
    out = flagged.groupBy("block", "idx").agg(F.expr("count(1) AS rows"), F.expr("sum(gap) AS missing"))
    return with_names(out.withColumn("missing_pct", F.expr("missing * 100.0D / rows")), names).select(
        "block", "column", "rows", "missing", "missing_pct"
    )


def _histogram(df: DataFrame, names: list[str], bins: int) -> DataFrame:
    # one row with the finite range of each column; a constant column gets v - w .. v + w,
    # w one half or, where that is lost in rounding, a share of v
    ends = ", ".join(f"struct(min({as_finite(df, n)}) AS lo, max({as_finite(df, n)}) AS hi)" for n in names)
    half = "greatest(0.5D, abs(b.lo) * power(2D, -44))"
    wide = f"transform(array({ends}), b -> IF(b.lo = b.hi, struct(b.lo - {half} AS lo, b.hi + {half} AS hi), b))"
    # one row per column; joined, so that no expression repeats the aggregate
    bounds = df.agg(F.expr(wide).alias("ends")).selectExpr("posexplode(ends) AS (idx, b)")
    bounds = F.broadcast(bounds.selectExpr("idx", "b.lo AS lo", "b.hi AS hi", f"(b.hi - b.lo) / {bins} AS step"))
    finite = "abs(value) < double('Infinity')"
    spot = (
        long_numbers(df, names)
        .where("value IS NOT NULL")
        .join(bounds, "idx")
        .selectExpr("*", f"IF({finite}, least(floor(try_divide(value - lo, hi - lo) * {bins}), {bins - 1}), NULL) AS guess")
    )
    # the edges decide: lo + i * step, the last bin closed
    binned = spot.selectExpr(
        "idx",
        f"CAST(CASE WHEN NOT {finite} THEN IF(value < 0, -1, {bins}) "
        f"WHEN value < lo + guess * step THEN guess - 1 "
        f"WHEN guess < {bins - 1} AND value >= lo + (guess + 1) * step THEN guess + 1 "
        "ELSE guess END AS INT) AS bin",
    )
    counts = binned.groupBy("idx", "bin").agg(F.expr("count(1) AS count"))
    # bounded: columns * (bins + 2) rows
    slots = (
        df.sparkSession.range(len(names) * (bins + 2), numPartitions=1)
        .selectExpr(f"CAST(id DIV {bins + 2} AS INT) AS idx", f"CAST(id % {bins + 2} AS INT) - 1 AS bin")
        .join(bounds, "idx")
    )
    inside = f"bin BETWEEN 0 AND {bins - 1}"
    filled = (
        slots.join(F.broadcast(counts), ["idx", "bin"], "left")
        .where(f"IF({inside}, lo IS NOT NULL, count IS NOT NULL)")
        .selectExpr(
            "idx",
            "bin",
            f"CASE WHEN bin < 0 THEN -double('Infinity') WHEN bin = {bins} THEN double('Infinity') "
            "ELSE lo + bin * step END AS lower",
            f"CASE WHEN bin < 0 THEN -double('Infinity') WHEN bin = {bins} THEN double('Infinity') "
            f"WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * step END AS upper",
            "coalesce(count, 0L) AS count",
        )
    )
    total = f"sum(IF({inside}, count, 0L)) OVER (PARTITION BY idx)"
    density = f"IF({inside}, try_divide(count, {total} * (upper - lower)), NULL)"
    return with_names(filled.selectExpr("*", f"{density} AS density"), names)


def histogram_density(df: DataFrame, names: list[str] | None = None, bins: int = 30) -> DataFrame:
    """``(column, bin, lower, upper, count, density)`` of equal-width bins over the finite values.

    Infinite values, if any, are counted in bins of their own, -1 and ``bins``.
    """
    names = numeric_columns(df) if names is None else names
    return _histogram(df, names, bins) if names else empty(df, HISTOGRAM)


def histogram_count(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """``(bin, lower, upper, count)`` of one numeric column."""
    return _histogram(df, [name], bins).select("bin", "lower", "upper", "count")


def _power(k: int) -> str:
    """SQL of the k-th power of ``t``, ``t2`` being its square."""
    return " * ".join([*["t2"] * (k // 2), *["t"] * (k % 2)]) or "1D"


def kde(df: DataFrame, names: list[str] | None = None, points: int = 1000, bins: int | None = None) -> DataFrame:
    """``(column, point, x, density)``: Gaussian kernel density, Scott bandwidth.

    The grid reaches half a range beyond the data on each side.  Values are
    summed as powers of their distance t from the centre of a cell, combined before
    the shuffle; each cell then meets the grid points whose kernel is not exactly
    zero: exp(-(z - t)^2 / 2) is exp(-z^2 / 2) times the series of exp(z t), cut where
    it is exact to nine digits at the farthest point and to the last digit nearby.  So a value costs the same whatever
    the grid, and the cells grow with the width of the data in bandwidths only.

    With ``bins`` the values are first counted into that many equal bins and
    each bin acts as its centre: an approximation whose cost after one counting
    scan does not depend on the number of rows.  Infinite values are left out.
    """
    names = numeric_columns(df) if names is None else names
    if not names:
        return empty(df, "column string, point int, x double, density double")
    parts = ", ".join(
        "struct(count({0}) AS n, stddev_samp({0}) AS std, min({0}) AS lo, max({0}) AS hi)".format(as_finite(df, n))
        for n in names
    )
    # one row per column; joined, so that no expression repeats the aggregate
    stats = F.broadcast(
        df.agg(F.expr(f"array({parts}) AS s"))
        .selectExpr("posexplode(s) AS (idx, s)")
        .selectExpr(
            "idx", "s.n", "s.lo", "s.hi", "s.std * power(s.n, -0.2D) AS h", "s.lo - 0.5D * (s.hi - s.lo) AS x0", f"2 * (s.hi - s.lo) / {points - 1} AS step"
        )
    )
    values = long_numbers(df, names).where("abs(value) < double('Infinity')").join(stats, "idx").drop("n").where("h > 0")
    if bins is None:
        cells = (
            values.selectExpr("idx", "value", "lo", "h", f"floor((value - lo) / h * {KERNEL_CELLS}) AS cell")
            .selectExpr("idx", "cell", f"(value - lo) / h - (cell + 0.5D) / {KERNEL_CELLS} AS t")
            .selectExpr("idx", "cell", "t", "t * t AS t2", "exp(-0.5D * t * t) AS w")
            .groupBy("idx", "cell")
            .agg(*[F.expr(f"sum(w * {_power(k)}) / {factorial(k)}D AS w{k}") for k in range(KERNEL_TERMS)])
        )
        weighted = (
            cells.join(stats.drop("n", "hi"), "idx")
            .withColumn("value", F.expr(f"lo + (cell + 0.5D) / {KERNEL_CELLS} * h"))
            .drop("lo")
        )
        kernel = "0D"
        for k in reversed(range(KERNEL_TERMS)):
            kernel = f"({kernel} * z + w{k})"
        weights = [f"w{k}" for k in range(KERNEL_TERMS)]
    else:
        cell = f"least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1})"
        weighted = (
            values.selectExpr("*", f"{cell} AS cell")
            .groupBy("idx", "cell", "lo", "hi", "h", "x0", "step")
            .agg(F.expr("count(1) AS w"))
            .selectExpr("idx", f"lo + (cell + 0.5D) * (hi - lo) / {bins} AS value", "w", "h", "x0", "step")
        )
        kernel, weights = "w", ["w"]
    first = f"CAST(greatest(0, ceil((value - {KERNEL_REACH} * h - x0) / step)) AS INT)"
    last = f"CAST(least({points - 1}, floor((value + {KERNEL_REACH} * h - x0) / step)) AS INT)"
    sums = (
        weighted.selectExpr("*", f"{first} AS first", f"{last} AS last")
        .where("first <= last")  # a narrow kernel may fall between two grid points
        .selectExpr("*", "explode(sequence(first, last)) AS point")
        .selectExpr("idx", "point", *weights, "(x0 + point * step - value) / h AS z")
        .groupBy("idx", "point")
        .agg(F.expr(f"greatest(0D, sum({kernel} * exp(-0.5D * z * z))) AS mass"))
    )
    slots = (
        df.sparkSession.range(len(names) * points, numPartitions=1)
        .selectExpr(f"CAST(id DIV {points} AS INT) AS idx", f"CAST(id % {points} AS INT) AS point")
        .join(stats, "idx")
        .where("h > 0")
    )
    out = slots.join(F.broadcast(sums), ["idx", "point"], "left").selectExpr(
        "idx",
        "point",
        "x0 + point * step AS x",
        "coalesce(mass, 0D) / (n * h * sqrt(2 * pi())) AS density",
    )
    return with_names(out, names)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """``(value, count)`` of the non-missing values, most frequent first."""
    return (
        df.where(has_value(df, name))
        .groupBy(F.expr(f"{present(df, name)} AS value"))
        .agg(F.expr("count(1) AS count"))
        .orderBy(F.desc("count"), "value")
    )


def value_counts_topn(df: DataFrame, names: list[str] | None = None, top_n: int = 10) -> DataFrame:
    """``(column, value, count)``: the most frequent values of text and boolean columns.

    One scan: values combine before the shuffle, longer texts as their first characters
    and a digest, and the top rows are kept per task.  A second scan fetches the whole
    texts of those winners, ``top_n`` rows a column; no other text moves.  Ties go by
    value, between long texts that begin alike by digest.
    """
    names = columns_of(df, CATEGORICAL, BOOLEAN) if names is None else names
    if not names:
        return empty(df, "column string, value string, count bigint")

    def cells(with_text: bool):
        each = (f"{i}, {top_key(df, n)}" + f", CAST({quoted(n)} AS STRING)" * with_text for i, n in enumerate(names))
        return df.selectExpr(f"stack({len(names)}, {', '.join(each)}) AS (idx, key{', value' * with_text})").where("key IS NOT NULL")

    # the mark that tells long texts is no part of the order
    order = Window.partitionBy("idx").orderBy(F.desc("count"), F.expr("substring(key, 2)"))
    counts = cells(False).groupBy("idx", "key").agg(F.expr("count(1) AS count"))
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n)
    long = F.broadcast(top.where("key LIKE '#%'").select("idx", "key"))
    texts = cells(True).join(long, ["idx", "key"], "left_semi").groupBy("idx", "key").agg(F.first("value").alias("value"))
    out = top.join(F.broadcast(texts), ["idx", "key"], "left").selectExpr("idx", "place", "coalesce(value, substring(key, 2)) AS value", "count")
    return with_names(out, names).orderBy("column", "place").select("column", "value", "count")


def proportions(df: DataFrame, name: str) -> DataFrame:
    """``(value, count, pct)`` with the non-missing rows as the whole."""
    total = df.agg(F.expr(f"count({present(df, name)}) AS total")).scalar()
    return (
        value_counts(df, name)
        .withColumn("pct", F.col("count") * F.lit(100.0) / total)
        .orderBy(F.desc("count"), "value")
    )


def box_stats(
    df: DataFrame, names: list[str] | None = None, exact: bool = True, ranges: Ranges | None = None
) -> DataFrame:
    """``(column, q1, median, q3, whisker_low, whisker_high, fliers)``.

    A whisker ends at the farthest value inside 1.5 interquartile ranges.
    """
    names = numeric_columns(df) if names is None else names
    if not names:
        return empty(
            df,
            "column string, q1 double, median double, q3 double, "
            "whisker_low double, whisker_high double, fliers bigint",
        )
    inside = "value BETWEEN f.lower AND f.upper"
    fence = F.get(fences(df, names, exact, ranges), F.col("idx"))
    ends = (
        long_numbers(df, names)
        .where("value IS NOT NULL")
        .withColumn("f", fence)
        .groupBy("idx")
        .agg(
            F.expr(f"min(IF({inside}, value, NULL)) AS lo"),
            F.expr(f"max(IF({inside}, value, NULL)) AS hi"),
            F.expr("count_if(value < f.lower OR value > f.upper) AS fliers"),
        )
        .withColumn("f", fence)
        .selectExpr("idx", "f.q1", "f.median", "f.q3", "lo", "hi", "fliers")
    )
    out = ends.selectExpr(
        "idx", "q1", "median", "q3", "least(lo, q1) AS whisker_low", "greatest(hi, q3) AS whisker_high", "fliers"
    )
    return with_names(out, names)
