import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableassay.operators import relations as R


@pytest.fixture(scope="module")
def mixed(spark):
    cols = [f"IF(id % {p} = 0, NULL, sin(id * {i + 1}) + {i} * id / 300D) AS c{i}" for i, p in enumerate((3, 1000, 7, 1000, 11, 1000, 1000, 13))]
    return spark.range(1, 400).selectExpr(*cols, "5 AS flat", "CAST(NULL AS INT) AS nothing").cache()


def test_matrix_matches_pandas(mixed, by):
    want = mixed.toPandas().astype(float).corr()
    got = by(R.correlation_matrix(mixed), "feature_1", "feature_2")
    assert len(got) == 100
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert r["r"] is None if np.isnan(w) else r["r"] == pytest.approx(w, abs=1e-12), (a, b)


def test_no_null_rows_and_pairwise_constant(spark, by):
    # y is present only where x does not vary
    df = spark.sql("SELECT id * 1D AS x, IF(id = 3, 2D, NULL) AS y, IF(id < 5, 1D, id) AS z FROM range(10)")
    got = by(R.correlation_matrix(df), "feature_1", "feature_2")
    assert got["x", "y"]["r"] is None and got["x", "x"]["r"] == 1.0
    assert got["x", "z"]["r"] == pytest.approx(np.corrcoef(range(10), [1] * 5 + list(range(5, 10)))[0, 1])


def test_strong_pairs_and_triangle(mixed):
    want = mixed.toPandas().astype(float).corr()
    names = list(want.columns)
    strong = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if abs(want.loc[a, b]) > 0.7}
    got = R.high_correlations(mixed).collect()
    assert {(r["feature_1"], r["feature_2"]) for r in got} == strong
    sizes = [abs(r["r"]) for r in got]
    assert sizes == sorted(sizes, reverse=True)
    assert R.correlation_lower_triangle(mixed).count() == 45


def test_fewer_than_two_columns(spark):
    df = spark.range(3)
    for op in (R.correlation_matrix, R.high_correlations, R.correlation_lower_triangle):
        assert op(df).count() == 0


def test_outliers_strict_and_over_all_rows(spark, by):
    # q1 = 2, q3 = 4 with fences at -1 and 7: 7 itself is inside
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 3.0, 4.0, 4.0, 7.0, None, 50.0, float("nan"))], "x double")
    values = np.array([1, 2, 2, 3, 4, 4, 7, 50.0])
    q1, q3 = np.percentile(values, [25, 75])
    far = [v for v in values if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    r = by(R.outlier_detection(df))["x"]
    assert r["outliers"] == len(far) and r["outlier_pct"] == pytest.approx(len(far) * 10)
    assert [x[0] for x in R.outlier_rows(df, "x").collect()] == far
    exactly = spark.createDataFrame([(0.0,)] * 2 + [(1.0,)] * 2 + [(2.5,)], "x double")
    assert R.outlier_rows(exactly, "x").count() == 0


def test_outlier_columns_without_values(gappy, by):
    got = by(R.outlier_detection(gappy))
    assert got["nothing"]["outliers"] == 0 and got["same"]["outliers"] == 0 and len(got) == 5


def test_targets(gappy, by):
    assert {r["value"] for r in R.target_distribution(gappy, "flag").collect()} == {True, False}
    assert R.target_distribution(gappy, "day").count() == 50
    assert by(R.target_distribution(gappy, "id"))["count"]["value"] == 50
    want = gappy.toPandas()[["id", "x", "y", "same", "nothing"]].astype(float).corr()["id"].drop("id").abs()
    got = by(R.target_correlation(gappy, "id"))
    assert got["x"]["abs_r"] == pytest.approx(want["x"]) and got["y"]["abs_r"] == pytest.approx(want["y"])
    assert got["same"]["abs_r"] is None
    assert [r["feature"] for r in R.target_top_features(gappy, "id", k=2).collect()] == ["x", "y"]
    assert R.target_correlation(gappy, "word").count() == 0


def test_scatter_grid_counts_every_pair(gappy):
    got = R.scatter_grid(gappy, "id", k=2, bins=5).groupBy("feature").sum("count").collect()
    pdf = gappy.toPandas()
    assert {r[0]: r[1] for r in got} == {"x": pdf["x"].notna().sum(), "y": pdf["y"].notna().sum()}


def test_cells_that_are_not_finite_leave_their_pairs_only(spark, by):
    cell = "CASE WHEN id % 3 = {0} THEN NULL WHEN id % 11 = {1} THEN double('Infinity') WHEN id % 13 = {1} THEN double('NaN') ELSE sin(id * {2}) + id * 1e-3 END"
    names = [f"{cell.format(i % 3, i, i + 1)} AS c{i}" for i in range(4)]
    df = spark.range(1, 500, numPartitions=9).selectExpr(*names, "IF(id = 7, -double('Infinity'), 1e9D + id) AS far", "double('Infinity') AS never")
    table = df.toPandas()
    want = table.where(np.isfinite(table)).corr()
    got = by(R.correlation_matrix(df), "feature_1", "feature_2")
    assert len(got) == 36
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert r["r"] is None if np.isnan(w) else r["r"] == pytest.approx(w, abs=1e-9), (a, b)
    target = by(R.target_correlation(df, "far"))
    assert target["c1"]["abs_r"] == pytest.approx(abs(want.loc["c1", "far"]), abs=1e-9) and target["never"]["abs_r"] is None


def test_gram_merges_in_any_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 5)) * [1, 1e6, 1e-6, 1, 1] + [0, 1e9, 1, -1e7, 3]
    x[:, 3] += x[:, 0]
    x[rng.random(x.shape) < 0.3] = np.nan
    import pandas as pd

    want = pd.DataFrame(x).corr().to_numpy()
    for cuts in ([500], [1, 2, 3, 999], list(range(50, 1000, 50))):
        gram = R.Gram(list(range(5)), 5)
        for part in np.split(x, cuts)[::-1]:
            gram.add(gram.unpack(gram.rows(part).packed()))
        np.testing.assert_allclose(gram.correlations(), want, atol=1e-9)


def test_correlation_plan_of_many_columns(spark, tmp_path):
    import time

    spark.range(10).selectExpr(*[f"id * {i} + rand({i}) AS c{i}" for i in range(48)]).write.parquet(str(tmp_path / "wide"))
    start = time.time()
    df = R.correlation_matrix(spark.read.parquet(str(tmp_path / "wide")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 5 and plan.count("FileScan") == 1
    assert df.count() == 48 * 48


def test_correlation_of_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {tuple(r) for r in R.correlation_matrix(df).collect()} == {(x, y, None) for x in "ab" for y in "ab"}


def test_scatter_points_are_drawn_alike(spark):
    df = spark.range(5000, numPartitions=7).selectExpr(
        "id", "IF(id % 10 = 0, NULL, id * 1D) AS x", "IF(id = 3, double('Infinity'), id + sin(id)) AS y", "double('Infinity') AS z"
    )
    draw = lambda d: {tuple(r) for r in R.scatter_points(d, "y", ["x", "z"], points=100, key=["id"]).collect()}
    first = draw(df)
    assert len(first) == 100 and {f for f, *_ in first} == {"x"} and all(np.isfinite(v) for r in first for v in r[1:])
    assert draw(df.repartition(3)) == first
    assert 2000 < np.mean([x for _, x, _ in first]) < 3000
    assert R.scatter_points(df, "y", ["x"], points=100).count() == 100
    assert R.scatter_points(df.where("false"), "y", ["x"]).count() == 0


def test_scatter_points_hold_few_rows_per_task(spark):
    """Copies of a key, and no sort or window over all rows: only tasks' first rows travel."""
    df = spark.range(3000, numPartitions=6).selectExpr("id % 40 AS id", "id % 7 * 1D AS x", "-(id % 5) * 1D AS y", "id % 3 AS w")
    out = R.scatter_points(df, "y", ["x", "w"], points=90, key=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2 and "Window" not in plan and "Sort" not in plan
    rows = [(hashlib.md5(f"points-1:{r['id']}".encode()).hexdigest(), r["x"], float(r["w"]), r["y"]) for r in df.collect()]
    for feature, at in (("x", 1), ("w", 2)):
        want = sorted((r[0], r[at], r[3]) for r in rows)[:90]
        assert sorted((r["x"], r["y"]) for r in out.where(F.col("feature") == feature).collect()) == sorted(w[1:] for w in want)
