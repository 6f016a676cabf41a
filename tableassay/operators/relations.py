"""Correlation, outliers and the relation of features to a target."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableassay.functions.schema import (
    NUMERIC,
    as_double,
    as_finite,
    col,
    column_class,
    empty,
    flat_columns,
    has_value,
    numeric_columns,
    text,
    texts,
    union_all,
)
from tableassay.functions.shape import long_numbers, with_names
from tableassay.functions.values import identity_text
from tableassay.operators.distributions import value_counts
from tableassay.operators.quantiles import Ranges, fences
from tableassay.operators.stats import describe

# Fixed value: correlations above it count as strong.
STRONG = 0.7

_FIELDS = ("n", "mx", "my", "cxx", "cyy", "cxy", "xlo", "xhi", "ylo", "yhi")


class Gram:
    """Co-moments of pairs of columns, each over the rows that hold both.

    ``left`` columns against all: arrays of one row per left column.  Rows come as a
    matrix with NaN for cells that are missing; products of the cells and of their masks
    are matrix products.  States merge in any order, so tasks build one each.
    """

    def __init__(self, left: list[int], k: int):
        self.left = left
        self.state = {f: np.zeros((len(left), k)) for f in _FIELDS[:6]}
        self.state |= {f: np.full((len(left), k), np.inf if f.endswith("lo") else -np.inf) for f in _FIELDS[6:]}

    def rows(self, values: np.ndarray) -> Gram:
        """The state of one block of rows."""
        left, held = self.left, ~np.isnan(values)
        full = held.all(axis=0)
        # sums around a value of the block stay precise far from zero
        centre = np.divide(np.where(held, values, 0).sum(axis=0), held.sum(axis=0), out=np.zeros(values.shape[1]), where=held.any(axis=0))
        x, m = np.where(held, values - centre, 0), held.astype(np.float64)
        xl, ml = x[:, left], m[:, left]
        n, sx, sy = ml.T @ m, xl.T @ m, ml.T @ x
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            dx, dy = (np.where(n > 0, s / n, 0) for s in (sx, sy))
            cxx, cyy, cxy = (xl * xl).T @ m - n * dx * dx, ml.T @ (x * x) - n * dy * dy, xl.T @ x - n * dx * dy
        low, high = np.where(held, values, np.inf), np.where(held, values, -np.inf)
        ylo, yhi = (np.tile(v, (len(left), 1)) for v in (low.min(axis=0, initial=np.inf), high.max(axis=0, initial=-np.inf)))
        xlo, xhi = (np.tile(v[0, left][:, None], (1, values.shape[1])) for v in (ylo, yhi)) if left else (ylo, yhi)
        for at, i in enumerate(left):
            if not full[i]:
                ylo[at], yhi[at] = low[held[:, i]].min(axis=0, initial=np.inf), high[held[:, i]].max(axis=0, initial=-np.inf)
        for j in np.flatnonzero(~full):
            xlo[:, j], xhi[:, j] = low[held[:, j]][:, left].min(axis=0, initial=np.inf), high[held[:, j]][:, left].max(axis=0, initial=-np.inf)
        out = Gram(left, values.shape[1])
        out.state = dict(zip(_FIELDS, (n, centre[left][:, None] + dx, centre[None, :] + dy, cxx, cyy, cxy, xlo, xhi, ylo, yhi)))
        return out

    def add(self, other: Gram) -> None:
        a, b = self.state, other.state
        n = a["n"] + b["n"]
        with np.errstate(invalid="ignore", over="ignore"):
            share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
            dx, dy = (np.where(b["n"] > 0, b[m] - a[m], 0) for m in ("mx", "my"))
            for c, d in (("cxx", dx * dx), ("cyy", dy * dy), ("cxy", dx * dy)):
                a[c] = a[c] + b[c] + np.where(a["n"] > 0, d * a["n"] * share, 0)
            a["mx"], a["my"] = a["mx"] + dx * share, a["my"] + dy * share
        a["n"] = n
        for f in _FIELDS[6:]:
            a[f] = (np.minimum if f.endswith("lo") else np.maximum)(a[f], b[f])

    def correlations(self) -> np.ndarray:
        """r of each left column and column, NaN where there is none."""
        s = self.state
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            r = np.clip(s["cxy"] / (np.sqrt(s["cxx"]) * np.sqrt(s["cyy"])), -1, 1)
        r[np.array(self.left)[:, None] == np.arange(r.shape[1])] = 1
        r[(s["n"] == 0) | (s["xlo"] == s["xhi"]) | (s["ylo"] == s["yhi"])] = np.nan
        return r

    def packed(self) -> bytes:
        return np.stack([self.state[f] for f in _FIELDS]).tobytes()

    def unpack(self, data: bytes) -> Gram:
        out = Gram(self.left, self.state["n"].shape[1])
        out.state = dict(zip(_FIELDS, np.frombuffer(data).reshape(len(_FIELDS), len(self.left), -1).copy()))
        return out


def _pair_correlations(df: DataFrame, names: list[str], left: list[int] | None = None) -> DataFrame:
    """``(i, j, r)`` of the left columns and all; NULL where a column does not vary over the
    shared rows.  Cells that are not finite leave the pairs of their column, no others.

    One scan: a task returns one state, of a size that the columns alone decide, and
    states are merged in two levels."""
    k = len(names)
    left = list(range(k)) if left is None else left

    def summed(batches):
        gram = Gram(left, k)
        for batch in batches:
            if batch.num_rows:
                gram.add(gram.rows(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
        yield pa.RecordBatch.from_arrays([pa.array([gram.packed()], pa.binary())], ["state"])

    def merge(batches):
        gram = Gram(left, k)
        for batch in batches:
            for state in batch.column(0).to_pylist():
                gram.add(gram.unpack(state))
        return gram

    def merged(batches):
        yield pa.RecordBatch.from_arrays([pa.array([merge(batches).packed()], pa.binary())], ["state"])

    def finished(batches):
        r = merge(batches).correlations()
        i, j = np.indices(r.shape)
        values = pa.array(r.ravel(), mask=np.isnan(r.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(left, np.int32)[i.ravel()]), pa.array(j.ravel().astype(np.int32)), values], ["i", "j", "r"])

    tasks = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    states = df.selectExpr(*[f"{as_finite(df, n)} AS v{i}" for i, n in enumerate(names)]).mapInArrow(summed, "state binary")
    # a table without a task has no state: an empty one keeps its pairs
    states = states.unionByName(df.sparkSession.createDataFrame([(Gram(left, k).packed(),)], "state binary"))
    return states.repartition(tasks).mapInArrow(merged, "state binary").repartition(1).mapInArrow(finished, "i int, j int, r double")


def _upper(df: DataFrame, names: list[str]) -> DataFrame:
    """``(i, j, r)`` for i <= j."""
    return _pair_correlations(df, names).where("i <= j")


CORRELATION = "feature_1 string, feature_2 string, r double"


def _named(names: list[str], pairs: DataFrame) -> DataFrame:
    name = f"get({texts(names)}, {{}})"
    return pairs.selectExpr(f"{name.format('i')} AS feature_1", f"{name.format('j')} AS feature_2", "r")


def correlation_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(feature_1, feature_2, r)``: Pearson over pairwise complete rows."""
    names = numeric_columns(df) if names is None else names
    if len(names) < 2:
        return empty(df, CORRELATION)
    both = _upper(df, names).selectExpr(
        "inline(IF(i = j, array(struct(i, j, r)), array(struct(i, j, r), struct(j AS i, i AS j, r))))"
    )
    return _named(names, both)


def high_correlations(df: DataFrame, names: list[str] | None = None, threshold: float = STRONG) -> DataFrame:
    """Pairs with ``|r|`` above the threshold, strongest first."""
    names = numeric_columns(df) if names is None else names
    if len(names) < 2:
        return empty(df, CORRELATION)
    strong = _upper(df, names).where(f"i < j AND abs(r) > {threshold}D")
    return _named(names, strong).orderBy(F.abs("r").desc(), "feature_1", "feature_2")


def correlation_lower_triangle(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The cells below the diagonal."""
    names = numeric_columns(df) if names is None else names
    if len(names) < 2:
        return empty(df, CORRELATION)
    return _named(names, _upper(df, names).where("i < j").selectExpr("j AS i", "i AS j", "r"))


def outlier_detection(
    df: DataFrame, names: list[str] | None = None, exact: bool = True, ranges: Ranges | None = None
) -> DataFrame:
    """``(column, outliers, outlier_pct)``, percent of all rows, most first."""
    names = numeric_columns(df) if names is None else names
    if not names:
        return empty(df, "column string, outliers bigint, outlier_pct double")
    counted = (
        long_numbers(df, names)
        .withColumn("f", F.get(fences(df, names, exact, ranges), F.col("idx")))
        .groupBy("idx")
        .agg(F.expr("count_if(value < f.lower OR value > f.upper) AS outliers"), F.expr("count(1) AS rows"))
    )
    out = with_names(counted, names).selectExpr(
        "column", "outliers", "try_divide(outliers * 100.0D, rows) AS outlier_pct"
    )
    return out.orderBy(F.desc("outliers"), "column")


def outlier_rows(df: DataFrame, name: str, exact: bool = True, ranges: Ranges | None = None) -> DataFrame:
    """The rows outside the fences of one column.

    Doubles are compared as they are stored, so that the bounds reach the scan.
    """
    bounds = F.get(fences(df, [name], exact, ranges), F.lit(0))
    value = col(name) if df.schema[name].dataType == T.DoubleType() else F.expr(as_double(df, name))
    far = (value < bounds["lower"]) | (value > bounds["upper"])
    return df.where(far & F.expr(has_value(df, name)))


def is_numeric_target(df: DataFrame, target: str) -> bool:
    return column_class(df.schema[target].dataType) == NUMERIC


def target_distribution(df: DataFrame, target: str, exact: bool = True, ranges: Ranges | None = None) -> DataFrame:
    """``describe`` of a numeric target, otherwise its value counts."""
    if is_numeric_target(df, target):
        return describe(df, [target], exact, ranges).select("stat", "value")
    return value_counts(df, target)


def target_correlation(df: DataFrame, target: str, names: list[str] | None = None, top_n: int = 10) -> DataFrame:
    """``(feature, abs_r)``: the features closest to a numeric target."""
    features = [n for n in (numeric_columns(df) if names is None else names) if n != target]
    if not features or not is_numeric_target(df, target):
        return empty(df, "feature string, abs_r double")
    pairs = _pair_correlations(df, [target, *features], [0]).where("j > 0")
    return (
        _named([target, *features], pairs)
        .selectExpr("feature_2 AS feature", "abs(r) AS abs_r")
        .orderBy(F.desc_nulls_last("abs_r"), "feature")
        .limit(top_n)
    )


def target_top_features(df: DataFrame, target: str, names: list[str] | None = None, k: int = 4) -> DataFrame:
    return target_correlation(df, target, names).limit(k)


def scatter_grid(df: DataFrame, target: str, names: list[str] | None = None, k: int = 4, bins: int = 50) -> DataFrame:
    """``(feature, x_bin, y_bin, x_low, y_low, count)`` of the strongest features.

    The table of a scatter plot: finite rows per cell of a grid, empty cells left out.
    Runs one job when called, which names the features; only their columns are binned.
    """
    features = [n for n in (numeric_columns(df) if names is None else names) if n != target]
    if not features or not is_numeric_target(df, target):
        return empty(df, "feature string, x_bin int, y_bin int, x_low double, y_low double, count bigint")
    features = [r["feature"] for r in target_top_features(df, target, features, k).where("abs_r IS NOT NULL").collect()]
    if not features:
        return empty(df, "feature string, x_bin int, y_bin int, x_low double, y_low double, count bigint")
    ends = ", ".join(
        f"struct(min({as_finite(df, n)}) AS lo, max({as_finite(df, n)}) AS hi)" for n in [*features, target]
    )
    bounds = df.agg(F.expr(f"array({ends}) AS b")).scalar()
    rows = (
        long_numbers(df, features, keep=(f"{as_finite(df, target)} AS y",))
        .where("abs(value) < double('Infinity') AND y IS NOT NULL")
        .withColumn("feature", F.expr(f"get({texts(features)}, idx)"))
        .withColumn("b", bounds)
        .selectExpr("feature", "value AS x", "y", "get(b, idx) AS bx", f"get(b, {len(features)}) AS by")
    )
    spot = "CAST(least(coalesce(floor(try_divide({0} - {1}.lo, {1}.hi - {1}.lo) * {2}), 0), {3}) AS INT)"
    return (
        rows.selectExpr(
            "feature",
            spot.format("x", "bx", bins, bins - 1) + " AS x_bin",
            spot.format("y", "by", bins, bins - 1) + " AS y_bin",
            "bx",
            "by",
        )
        .groupBy("feature", "x_bin", "y_bin", "bx", "by")
        .agg(F.expr("count(1) AS count"))
        .selectExpr(
            "feature",
            "x_bin",
            "y_bin",
            f"bx.lo + x_bin * (bx.hi - bx.lo) / {bins} AS x_low",
            f"by.lo + y_bin * (by.hi - by.lo) / {bins} AS y_low",
            "count",
        )
    )


def scatter_points(
    df: DataFrame, target: str, names: list[str] | None = None, k: int = 4, points: int = 1000, key: list[str] | None = None, seed: str = "points-1"
) -> DataFrame:
    """``(feature, x, y)``: up to ``points`` rows of each of the strongest features.

    The rows with the smallest seeded hashes of their ``key`` (columns that name a row; the
    whole row if none are given), so a rerun draws the same ones.  Each feature is an order
    with a limit: a task holds ``points`` rows at a time and sends as many, and merging them
    is exact; the other rows are neither sorted nor written.  Runs one job when called, which
    names the features.
    """
    features = [n for n in (numeric_columns(df) if names is None else names) if n != target]
    schema = "feature string, x double, y double"
    if not features or not is_numeric_target(df, target):
        return empty(df, schema)
    features = [r["feature"] for r in target_top_features(df, target, features, k).where("abs_r IS NOT NULL").collect()]
    if not features:
        return empty(df, schema)
    cells = [f"coalesce({identity_text(df, n)}, '')" for n in (key or flat_columns(df))]
    draw = f"md5(CAST(concat_ws(':', {text(seed)}, {', '.join(cells)}) AS BINARY)) AS draw"
    drawn = []
    for feature in features:
        rows = df.selectExpr(f"{as_double(df, feature)} AS x", f"{as_finite(df, target)} AS y", draw)
        first = rows.where("abs(x) < double('Infinity') AND y IS NOT NULL").orderBy("draw", "x", "y").limit(points)
        drawn.append(first.select(F.lit(feature).alias("feature"), "x", "y"))
    return union_all(drawn)


def target_relation_rows(df: DataFrame, target: str) -> DataFrame:
    """``target_correlation`` in the long form of the reports."""
    return target_correlation(df, target).selectExpr(
        "'target' AS section", "feature AS column", f"concat('abs_r ', {text(target)}) AS metric", "abs_r AS value"
    )
