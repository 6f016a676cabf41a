import numpy as np
import pandas as pd
import pytest

from tableassay.operators import stats


def pandas_of(df):
    return df.drop("list").toPandas()


def test_column_types(gappy, by):
    got = {k: (r["dtype"], r["class"]) for k, r in by(stats.column_types(gappy)).items()}
    assert got["x"] == ("double", "numeric")
    assert got["word"] == ("string", "categorical")
    assert got["flag"] == ("boolean", "boolean")
    assert got["day"] == ("date", "datetime")
    assert got["list"] == ("array<bigint>", "nested")
    assert {r["class"]: r["columns"] for r in stats.class_counts(gappy).collect()}["numeric"] == 5


def test_missing_counts_nan_and_null(gappy, by):
    want = pandas_of(gappy).isnull().sum()
    got = by(stats.missing_summary(gappy))
    for c, n in want.items():
        assert got[c]["missing"] == n and got[c]["missing_pct"] == pytest.approx(n / 50 * 100)
    assert got["list"]["missing"] == 0
    order = [r["missing_pct"] for r in stats.missing_summary(gappy).collect()]
    assert order == sorted(order, reverse=True)
    assert set(by(stats.missing_nonzero(gappy))) == {c for c, n in want.items() if n}


def test_distinct_matches_pandas(gappy, by):
    got = by(stats.distinct_counts(gappy))
    for c, n in pandas_of(gappy).nunique().items():
        assert got[c]["distinct"] == n
    assert "list" not in got
    near = by(stats.distinct_counts(gappy, exact=False))
    assert near["nothing"]["distinct"] == 0 and abs(near["id"]["distinct"] - 50) <= 4


def test_distinct_long_texts(spark):
    df = spark.sql("SELECT repeat('a', 100 + CAST(id % 3 AS INT)) AS t FROM range(30)")
    assert stats.distinct_counts(df).first()["distinct"] == 3


def test_describe_and_moments_match_pandas(gappy, by):
    pdf = pandas_of(gappy)[["id", "x", "y", "same", "nothing"]].astype(float)
    got = by(stats.statistical_summary(gappy), "column", "stat")
    for c in pdf:
        want = {**pdf[c].describe().to_dict(), "skewness": pdf[c].skew(), "kurtosis": pdf[c].kurtosis(), "variance": pdf[c].var()}
        for stat, v in want.items():
            value = got[c, stat]["value"]
            if np.isnan(v):
                assert value is None, (c, stat)
            else:
                assert value == pytest.approx(v, rel=1e-9, abs=1e-9), (c, stat)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_few_rows(spark, n):
    df = spark.range(n).selectExpr("CAST(id * id AS DOUBLE) AS x")
    s = pd.Series([float(i * i) for i in range(n)], dtype=float)
    want = {"skewness": s.skew(), "kurtosis": s.kurtosis(), "variance": s.var()}
    for op in ("skewness", "kurtosis", "variance"):
        value = getattr(stats, op)(df).first()[op]
        assert value is None if np.isnan(want[op]) else value == pytest.approx(want[op])


def test_moments_keep_precision_far_from_zero(spark):
    df = spark.range(1000).selectExpr("1e9D + id % 7 AS x")
    s = pd.Series([1e9 + i % 7 for i in range(1000)])
    assert stats.variance(df).first()["variance"] == pytest.approx(s.var(), rel=1e-9)
    assert stats.kurtosis(df).first()["kurtosis"] == pytest.approx(s.kurtosis(), rel=1e-7)


def test_moments_off_centre(spark):
    # heavy tail: the median is far below the mean
    df = spark.range(2000).selectExpr("exp(id / 150D) AS x")
    s = df.toPandas()["x"]
    got = {r["stat"]: r["value"] for r in stats.statistical_summary(df).collect()}
    assert got["mean"] == pytest.approx(s.mean(), rel=1e-12)
    assert got["variance"] == pytest.approx(s.var(), rel=1e-10)
    assert got["skewness"] == pytest.approx(s.skew(), rel=1e-9)
    assert got["kurtosis"] == pytest.approx(s.kurtosis(), rel=1e-9)


def test_no_numeric_columns(spark):
    df = spark.sql("SELECT 'a' AS t")
    for op in (stats.describe, stats.statistical_summary, stats.skewness, stats.moments):
        assert op(df).count() == 0


def test_empty_table(spark, by):
    df = spark.createDataFrame([], "a int, b string")
    assert by(stats.missing_summary(df))["a"]["missing_pct"] is None
    assert stats.shape(df).first().asDict() == {"rows": 0, "columns": 2}
    got = by(stats.describe(df), "column", "stat")
    assert got["a", "count"]["value"] == 0 and got["a", "mean"]["value"] is None and got["a", "50%"]["value"] is None


def test_footprint(spark, by):
    df = spark.sql("SELECT CAST(1 AS INT) AS a, 'äb' AS b, CAST(NULL AS DOUBLE) AS c, array(1) AS d")
    got = {k: r["bytes"] for k, r in by(stats.column_footprint(df)).items()}
    assert got["a"] == 4 and got["b"] == 3 and got["c"] == 0 and got["d"] > 0


def test_basic_info(gappy, by):
    got = by(stats.basic_info(gappy))
    assert got["x"]["rows"] == 50 and got["list"]["distinct"] is None and got["same"]["distinct"] == 1


def test_one_scan_reads_only_numeric_columns(lineitem):
    plan = stats.variance(lineitem.select("l_tax", "l_returnflag"))._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan and "ReadSchema: struct<l_tax:double>" in plan


def test_variants_and_maps_have_an_identity(spark, by):
    from tableassay.operators import rules
    from tableassay.plans.profile import Profile

    df = spark.sql(
        """
        SELECT id, parse_json(IF(id % 5 = 0, NULL, IF(id % 2 = 0, '{"a": 1, "b": [2]}', '{"b": [2], "a": 1}'))) AS v,
               IF(id % 2 = 0, map('x', map(1, 2, 3, 4), 'y', NULL), map('y', NULL, 'x', map(3, 4, 1, 2))) AS m,
               array(named_struct('k', IF(id % 2 = 0, map(1, 'p', 2, 'q'), map(2, 'q', 1, 'p')))) AS list
        FROM range(20)
        """
    )
    assert by(stats.distinct_counts(df))["v"]["distinct"] == 1
    assert by(stats.distinct_counts(df, exact=False))["v"]["distinct"] == 1
    assert by(stats.basic_info(df))["v"]["missing"] == 4
    for names, copies in ((["m"], 19), (["list"], 19), (["v"], 18), (["id", "v"], 0)):
        assert rules.duplicate_rows(df, names).first()["duplicates"] == copies, names
    assert Profile(df).profile_report().count() > 10


def test_distinct_counts_take_one_scan(lineitem):
    for df in (stats.distinct_counts(lineitem), stats.basic_info(lineitem)):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2


def test_distinct_of_zeros_and_nothing(spark, by):
    df = spark.sql("SELECT * FROM VALUES (0D, 1BD, NULL), (-0D, 1.0BD, NULL), (double('NaN'), NULL, NULL), (double('Infinity'), 2BD, NULL) AS t(a, b, c)")
    got = by(stats.distinct_counts(df))
    assert [got[c]["distinct"] for c in "abc"] == [2, 2, 0]
    assert {r["distinct"] for r in stats.distinct_counts(df.where("false")).collect()} == {0}
