"""Feature and quality rules: ``(rule, column, metric, message)`` rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableassay.functions.schema import (
    categorical_columns,
    empty,
    flat_columns,
    has_value,
    numeric_columns,
    present,
    quoted,
    text,
    union_all,
)
from tableassay.functions.shape import inline_columns
from tableassay.functions.values import canonical, identity, is_number_text, looks_like_date
from tableassay.operators.stats import distinct_counts, skewness

RULE = "rule string, column string, metric double, message string"
NUMBERED = "number int, rule string, message string"

Keys = str | list[str] | None

# Thresholds (all strict) of the rules.
SKEW_LIMIT = 1.0
CARDINALITY_LIMIT = 0.5
MISSING_LIMIT = 0.5

# The advice given by each rule, word for word.
ADVICE = {
    "highly_skewed": "Consider log transformation for highly skewed features",
    "high_cardinality": "Consider grouping rare categories or using embedding techniques",
    "date_candidates": "Consider converting date strings to datetime and extracting features",
    "ratio_features": "Consider creating ratio features between numeric columns",
    "polynomial_features": "Consider polynomial features for important numeric features",
}
DUPLICATES = "Remove {} duplicate rows"
CONSTANT = "Consider removing constant columns: {}"
HIGH_MISSING = "Consider dropping or imputing high missing columns"
MIXED = "Review mixed data types in column: {}"


def _rule(rows: DataFrame, rule: str, metric: str, message: str) -> DataFrame:
    return rows.selectExpr(f"'{rule}' AS rule", "column", f"CAST({metric} AS DOUBLE) AS metric", f"{message} AS message")


def highly_skewed(df: DataFrame, names: list[str] | None = None, limit: float = SKEW_LIMIT) -> DataFrame:
    """Numeric columns whose absolute skewness is above the limit, most skewed first."""
    rows = skewness(df, names).where(f"NOT isnan(skewness) AND abs(skewness) > {limit}D")
    return _rule(rows, "highly_skewed", "abs(skewness)", text(ADVICE["highly_skewed"])).orderBy(
        F.desc("metric"), "column"
    )


def high_cardinality(df: DataFrame, names: list[str] | None = None, limit: float = CARDINALITY_LIMIT) -> DataFrame:
    """Text columns with more distinct values than the limit's share of all rows."""
    names = categorical_columns(df) if names is None else names
    if not names:
        return empty(df, RULE)
    total = df.agg(F.expr("CAST(count(1) AS DOUBLE) AS total")).scalar()
    rows = distinct_counts(df, names).withColumn("total", total).selectExpr(
        "column", "try_divide(distinct, total) AS share"
    )
    return _rule(rows.where(f"share > {limit}D"), "high_cardinality", "share", text(ADVICE["high_cardinality"]))


def _first_values(df: DataFrame, name: str, order_by: list[str], k: int) -> DataFrame:
    """The first ``k`` non-missing values by the key: a top-k per task, no sort."""
    keys = [F.col(quoted(c)) for c in order_by]
    return df.where(has_value(df, name)).orderBy(*keys).limit(k).selectExpr(f"{quoted(name)} AS v")


def _hits(df: DataFrame, names: list[str], test: Callable[[str], str], order_by: Keys, first: int | None) -> DataFrame:
    """``(column, n, hits)``: values and those that pass ``test``, of whole columns in one
    aggregate, or of the ``first`` values by the key."""
    if first is None:
        row = df.agg(
            *[F.expr(f"count({quoted(n)}) AS n{i}") for i, n in enumerate(names)],
            *[F.expr(f"count_if({test(quoted(n))}) AS c{i}") for i, n in enumerate(names)],
        )
        at = range(len(names))
        return inline_columns(row, names, {"n": [f"n{i}" for i in at], "hits": [f"c{i}" for i in at]})
    if not order_by:
        raise ValueError("the first values of a table need a key: give order_by")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    counts = [F.expr("count(v) AS n"), F.expr(f"count_if({test('v')}) AS hits")]
    return union_all([_first_values(df, n, keys, first).agg(F.expr(f"{text(n)} AS column"), *counts) for n in names])


def date_candidates(
    df: DataFrame, order_by: Keys = None, names: list[str] | None = None, first: int | None = None
) -> DataFrame:
    """Text columns of which some values look like dates; metric is how many do.

    Whole columns, or the ``first`` values by ``order_by``."""
    names = categorical_columns(df) if names is None else names
    if not names:
        return empty(df, RULE)
    rows = _hits(df, names, looks_like_date, order_by, first)
    return _rule(rows.where("hits > 0"), "date_candidates", "hits", text(ADVICE["date_candidates"]))


def mixed_types(
    df: DataFrame, order_by: Keys = None, names: list[str] | None = None, first: int | None = None
) -> DataFrame:
    """Text columns of which some, not all, values read as numbers.

    Whole columns, or the ``first`` values by ``order_by``."""
    names = categorical_columns(df) if names is None else names
    if not names:
        return empty(df, RULE)
    rows = _hits(df, names, is_number_text, order_by, first)
    message = "concat({}, column)".format(text(MIXED.format("")))
    return _rule(rows.where("hits > 0 AND hits < n"), "mixed_types", "hits", message)


def duplicate_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(duplicates, duplicate_pct)``: rows equal to an earlier one; missing equals missing.

    Copies combine before the shuffle, so a row that fills a third of the table
    crosses the network once per task; long texts and nested values travel as
    digests, nested ones of their JSON form with map entries in order.
    """
    names = df.columns if names is None else names
    flat = set(flat_columns(df))
    nested = "sha2(to_json(struct({} AS v), map('ignoreNullFields', 'false')), 256)"
    keys = [F.expr(f"{identity(df, n) if n in flat else nested.format(canonical(quoted(n), df.schema[n].dataType))} AS k{i}") for i, n in enumerate(names)]
    if not keys:
        return empty(df, "duplicates bigint, duplicate_pct double")
    groups = df.groupBy(*keys).agg(F.expr("count(1) AS n"))
    return groups.agg(F.expr("coalesce(sum(n - 1), 0L) AS duplicates"), F.expr("sum(n) AS rows")).selectExpr(
        "duplicates", "coalesce(try_divide(duplicates * 100.0D, rows), 0D) AS duplicate_pct"
    )


def constant_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Columns with at most one distinct value; metric is that number.

    A column is constant when its smallest value is its largest: one scan with
    no distinct counting and no shuffle of values.
    """
    names = flat_columns(df) if names is None else names
    if not names:
        return empty(df, RULE)
    row = df.agg(
        *[F.expr(f"{f}({present(df, n)}) AS {f}{i}") for i, n in enumerate(names) for f in ("min", "max")]
    )
    at = range(len(names))
    rows = inline_columns(
        row,
        names,
        {
            "position": [str(i) for i in at],
            "constant": [f"coalesce(min{i} = max{i}, true)" for i in at],
            "values": [f"IF(min{i} IS NULL, 0, 1)" for i in at],
        },
    )
    message = "concat({}, '[', {}, column, {}, ']')".format(text(CONSTANT.format("")), text("'"), text("'"))
    return _rule(rows.where("constant").orderBy("position"), "constant_columns", "values", message)


def high_missing(df: DataFrame, names: list[str] | None = None, limit: float = MISSING_LIMIT) -> DataFrame:
    """Columns whose share of missing cells is above the limit."""
    names = df.columns if names is None else names
    row = df.agg(*[F.expr(f"avg(IF({has_value(df, n)}, 0, 1)) AS a{i}") for i, n in enumerate(names)])
    rows = inline_columns(row, names, {"share": [f"a{i}" for i in range(len(names))]})
    return _rule(rows.where(f"share > {limit}D"), "high_missing", "share", text(HIGH_MISSING))


def _numbered(rows: list[DataFrame]) -> DataFrame:
    """Number findings by rule order; a few rows, one per finding."""
    found = union_all([r.withColumn("place", F.lit(i)) for i, r in enumerate(rows)])
    return found.selectExpr(
        "CAST(row_number() OVER (ORDER BY place, message) AS INT) AS number", "rule", "message"
    ).orderBy("number")


def feature_insights(df: DataFrame) -> DataFrame:
    """``(number, rule, message)``: one piece of advice per rule that fires."""
    fired = [highly_skewed(df), high_cardinality(df), date_candidates(df)]
    rows = [r.select("rule", "message").distinct() for r in fired]
    if len(numeric_columns(df)) >= 2:
        fixed = [(k, ADVICE[k]) for k in ("ratio_features", "polynomial_features")]
        values = ", ".join(f"struct('{k}' AS rule, {text(m)} AS message)" for k, m in fixed)
        one = df.sparkSession.range(1, numPartitions=1).selectExpr(f"inline(array({values}))")
        rows += [one.where(f"rule = '{k}'") for k, _ in fixed]
    return _numbered(rows)


def quality_issues(df: DataFrame) -> DataFrame:
    """``(number, rule, message)``: duplicates, constant, missing, mixed."""
    duplicates = duplicate_rows(df).where("duplicates > 0")
    before, after = DUPLICATES.split("{}")
    listed = (
        constant_columns(df)
        .agg(F.expr("collect_list(column) AS names"))
        .where("size(names) > 0")
        .selectExpr(
            "'constant_columns' AS rule",
            "concat({}, '[', array_join(transform(names, n -> concat({q}, n, {q})), ', '), ']') AS message".format(
                text(CONSTANT.format("")), q=text("'")
            ),
        )
    )
    return _numbered(
        [
            duplicates.selectExpr(
                "'duplicate_rows' AS rule", f"concat({text(before)}, duplicates, {text(after)}) AS message"
            ),
            listed,
            high_missing(df).select("rule", "message").distinct(),
            mixed_types(df).select("rule", "message"),
        ]
    )
