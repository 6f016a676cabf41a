import datetime as dt

import pytest

from tableassay.operators import calendar as C
from tableassay.operators.uplift import uplift_summary


@pytest.fixture(scope="module")
def times(spark):
    return spark.sql(
        """SELECT TIMESTAMP_NTZ'2024-01-01 05:30:00' + make_dt_interval(0, CAST(id * 7 AS INT)) AS t,
                  IF(id = 0, NULL, DATE'2023-12-31' + CAST(id AS INT)) AS d,
                  TIMESTAMP'2024-01-01 00:00:00Z' AS z
           FROM range(100)"""
    ).cache()


def test_date_range(times, by):
    got = by(C.date_range(times))
    assert got["t"]["first"] == dt.datetime(2024, 1, 1, 5, 30) and got["t"]["seconds"] == 99 * 7 * 3600
    assert got["d"]["seconds"] == 98 * 86400 and got["z"]["seconds"] == 0


def test_features_match_pandas(times):
    pdf = times.toPandas()
    got = C.calendar_features(times, "t").toPandas()
    for part in ("year", "month", "day", "dayofweek", "hour"):
        assert (got[f"t_{part}"] == getattr(pdf["t"].dt, part)).all()
    assert times.columns == ["t", "d", "z"]
    assert C.calendar_features(times, "d").where("d_hour IS NOT NULL").count() == 0


def test_counts(times, by):
    days = by(C.daily_counts(times, ["t"]), "day")
    want = times.toPandas()["t"].dt.date.value_counts()
    assert {k: r["rows"] for k, r in days.items()} == want.to_dict()
    assert by(C.weekday_pattern(times, ["d"]), "dayofweek")[0]["rows"] > 0
    assert C.monthly_pattern(times, ["d"]).agg({"rows": "sum"}).first()[0] == 99
    assert {r["column"] for r in C.hourly_pattern(times).collect()} == {"t", "z"}
    assert C.daily_counts(times.select(), []).count() == 0


def test_uplift_example(spark, by):
    df = spark.createDataFrame(
        [
            ("NY", 1200.0, 1000.0, 0.20, 0.10, 0.30, 0.01),
            ("CA", 900.0, 850.0, 0.06, -0.05, 0.15, 0.20),
            ("TX", 1500.0, 1300.0, 0.15, 0.05, 0.25, 0.03),
        ],
        "geo string, treatment double, control double, lift double, ci_low double, ci_high double, p_value double",
    )
    got = by(uplift_summary(df))
    assert [got[g]["recommendation"] for g in ("NY", "CA", "TX")] == ["increase", "reassess", "increase"]
    assert got["NY"]["message"] == "NY uplift +20% (95% CI: 10%–30%), statistically significant"
    assert got["CA"]["message"] == "CA uplift not significant, CI includes 0"
    derived = by(uplift_summary(df.selectExpr("*").withColumn("lift", df["lift"] * float("nan")).selectExpr(
        "geo", "treatment", "control", "CAST(NULL AS DOUBLE) AS lift", "ci_low", "ci_high", "p_value")))
    assert [round(derived[g]["lift"], 2) for g in ("NY", "CA", "TX")] == [0.20, 0.06, 0.15]
