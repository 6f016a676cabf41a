import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tableassay.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def values(df, names, probs=PROBS):
    return {(r["column"], r["prob"]): r["value"] for r in Q.exact_quantiles(df, names, probs).collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e9, 1e9)), min_size=1, max_size=60))
def test_small_columns_match_pandas(spark, data):
    got = values(spark.createDataFrame([(v,) for v in data], "x double"), ["x"])
    want = pd.Series(data, dtype=float).quantile(PROBS)
    for p in PROBS:
        if np.isnan(want[p]):
            assert got["x", p] is None
        else:
            assert got["x", p] == pytest.approx(want[p], rel=1e-12, abs=1e-12)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value; tails of very different scale."""
    return spark.sql(
        """SELECT IF(id % 3 = 0, 7D, exp(30 * (id % 9973) / 9973D)) AS heavy,
                  CAST(id % 50 AS INT) AS few, -id * 1D AS falling, IF(id % 100 = 0, 1D, NULL) AS rare
           FROM range(60000)"""
    ).cache()


@pytest.mark.parametrize("limit", [1, 5000, Q.ORDERED_ROWS])
def test_narrowing_matches_pandas(skewed, monkeypatch, limit):
    jobs = []
    read = Q._read
    monkeypatch.setattr(Q, "_read", lambda df, pieces: jobs.append(len(pieces)) or read(df, pieces))
    monkeypatch.setattr(Q, "ORDERED_ROWS", limit)
    want = skewed.toPandas().quantile(PROBS)
    got = values(skewed, skewed.columns)
    for c in skewed.columns:
        for p in PROBS:
            assert got[c, p] == pytest.approx(want.loc[p, c], rel=1e-12)
    assert len(jobs) == 1 if limit == Q.ORDERED_ROWS else 2 <= len(jobs) <= 4


def test_ranges_end_up_small(skewed, monkeypatch):
    monkeypatch.setattr(Q, "ORDERED_ROWS", 3000)
    found = Q.brackets(skewed, ["falling", "heavy"], [0.25, 0.5, 0.75])
    for name, b in found.items():
        for lo, hi in b.ends:
            assert skewed.where(f"{name} BETWEEN {lo}D AND {hi}D").select(name).distinct().count() <= Q.SMALL


def test_quartile_at_the_edge_of_a_frequent_value(spark, monkeypatch):
    monkeypatch.setattr(Q, "ORDERED_ROWS", 5000)
    df = spark.sql("SELECT IF(id % 10000 < 7499, 0D, 1 + sqrt(id)) AS x, IF(id % 10000 < 2501, -5D, -sqrt(id)) AS y FROM range(300000)").cache()
    probs = [0.25, 0.5, 0.75]
    want = df.toPandas().quantile(probs)
    got = values(df, ["x", "y"], probs)
    for c in ("x", "y"):
        for p in probs:
            assert got[c, p] == pytest.approx(want.loc[p, c], rel=1e-12)
        held = " OR ".join(f"{c} BETWEEN {lo!r}D AND {hi!r}D" for lo, hi in Q.brackets(df, [c], probs)[c].closed())
        assert df.where(held).select(c).distinct().count() <= 2 * Q.SMALL


def test_close_probs(skewed, monkeypatch):
    monkeypatch.setattr(Q, "ORDERED_ROWS", 1)
    probs = [0.5, 0.5001, 0.501, 0.51]
    want = skewed.toPandas()["falling"].quantile(probs)
    got = values(skewed, ["falling"], probs)
    assert all(got["falling", p] == pytest.approx(want[p], rel=1e-12) for p in probs)


def test_wrong_range_raises(skewed):
    wrong = {"falling": Q.Bracket(60000, [(1.0, 2.0)], [1.0])}
    with pytest.raises(Exception, match="rank outside its range"):
        Q.exact_quantiles(skewed, ["falling"], [0.5], wrong).collect()


def test_infinite_values(spark):
    df = spark.sql("SELECT IF(id < 5, double('-Infinity'), IF(id > 94, double('Infinity'), id * 1D)) AS x FROM range(100)")
    got = values(df, ["x"], [0.0, 0.5, 1.0])
    assert got["x", 0.0] == float("-inf") and got["x", 1.0] == float("inf") and got["x", 0.5] == 49.5


def test_approximate_rank_error(skewed):
    got = {r["prob"]: r["value"] for r in Q.approx_quantiles(skewed, ["falling"], [0.1, 0.5, 0.9]).collect()}
    for p, v in got.items():
        assert abs((v + 60000) / 60000 - p) < 0.01


def test_odd_names_and_no_columns(spark):
    df = spark.range(10).withColumnRenamed("id", "a {b}.c`d 'e'")
    assert values(df, df.columns, [0.5]) == {(df.columns[0], 0.5): 4.5}
    assert Q.exact_quantiles(df, [], [0.5]).count() == 0
    assert Q.approx_quantiles(df, [], [0.5]).count() == 0


def test_many_columns_are_split(spark, monkeypatch):
    monkeypatch.setattr(Q, "COLUMNS_PER_PLAN", 2)
    df = spark.range(11).selectExpr(*[f"id * {i} AS c{i}" for i in range(5)])
    assert {c: v for (c, _), v in values(df, df.columns, [0.5]).items()} == {f"c{i}": 5.0 * i for i in range(5)}
