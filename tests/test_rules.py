import pytest

from tableassay.operators import rules as U


@pytest.fixture(scope="module")
def table(spark):
    return spark.sql(
        """SELECT id, exp(id / 10D) AS wide, CAST(id % 5 AS DOUBLE) AS even,
                  concat('name', id) AS name, concat('g', id % 4) AS grp,
                  IF(id < 12, '2024-01-01', 'none') AS early, IF(id < 20, 'none', '2024-01-01') AS late,
                  IF(id % 2 = 0, CAST(id AS STRING), 'n') AS mix, CAST(id AS STRING) AS digits,
                  IF(id < 26, NULL, 'x') AS half, 'k' AS one, CAST(NULL AS STRING) AS nothing
           FROM range(50)"""
    ).cache()


def names(df):
    return [r["column"] for r in df.collect()]


def test_feature_rules(table):
    assert names(U.highly_skewed(table)) == ["wide"]
    # 0.5 itself is not above the limit
    half = table.selectExpr("concat('a', id DIV 2) AS pairs", "name")
    assert names(U.high_cardinality(half)) == ["name"]
    assert set(names(U.high_cardinality(table))) == {"name", "mix", "digits"}


def test_dates_look_at_whole_columns_or_first_values(table, spark):
    assert names(U.date_candidates(table, "id", first=10)) == ["early"]
    assert set(names(U.date_candidates(table))) == {"early", "late"}
    weak = spark.sql("SELECT 1 AS k, '1-URGENT' AS a, '12:30:00' AS b, '2024/01/01' AS c, '20240101' AS d, '2024-1-1 ' AS e")
    assert names(U.date_candidates(weak)) == ["a", "b", "c"]


def test_mixed_types(table, spark):
    assert names(U.mixed_types(table)) == ["mix"]
    rows = [" 12 ", "1e5", "inf", "-.5", "7."]
    not_numbers = ["1d", "1f", "NaN", "1,000", "0x10", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "k int, v string")
    assert names(U.mixed_types(df)) == []
    for text in not_numbers:
        more = spark.createDataFrame([(0, "5"), (1, text)], "k int, v string")
        assert names(U.mixed_types(more)) == ["v"], text
    late = spark.sql("SELECT id, IF(id < 100, 'word', '5') AS v FROM range(200)")
    assert names(U.mixed_types(late, "id", first=100)) == [] and names(U.mixed_types(late)) == ["v"]


def test_first_values_need_a_key(table):
    with pytest.raises(ValueError, match="order_by"):
        U.date_candidates(table, first=10)


def test_constant_and_missing(table):
    got = {r["column"]: r["metric"] for r in U.constant_columns(table).collect()}
    assert got == {"half": 1.0, "one": 1.0, "nothing": 0.0}
    assert names(U.high_missing(table)) == ["half", "nothing"]
    exactly = table.selectExpr("IF(id % 2 = 0, NULL, id) AS a")
    assert names(U.high_missing(exactly)) == []


def test_duplicates(spark, gappy):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None), (None, None), (2, "")], "a int, b string")
    r = U.duplicate_rows(df).first()
    assert r["duplicates"] == 2 and r["duplicate_pct"] == pytest.approx(100 / 3)
    copies = gappy.unionAll(gappy.limit(7))
    assert U.duplicate_rows(copies, ["id", "x", "y"]).first()["duplicates"] == 7
    long = spark.sql("SELECT repeat('z', 200 + CAST(id % 2 AS INT)) AS t FROM range(10)")
    assert U.duplicate_rows(long).first()["duplicates"] == 8
    # a text must not equal the key of another text
    near = spark.sql("SELECT explode(array(repeat('q', 70), concat('#70:', sha2(repeat('q', 70), 256)))) AS t")
    assert U.duplicate_rows(near).first()["duplicates"] == 0
    assert U.duplicate_rows(spark.createDataFrame([], "a int")).first()["duplicates"] == 0


def test_insights_in_rule_order(table):
    got = [(r["number"], r["rule"]) for r in U.feature_insights(table).collect()]
    assert got == list(
        enumerate(["highly_skewed", "high_cardinality", "date_candidates", "ratio_features", "polynomial_features"], 1)
    )
    plain = table.select("even", "grp")
    assert U.feature_insights(plain).count() == 0


def test_quality_issues_in_rule_order(table):
    got = [r["message"] for r in U.quality_issues(table.unionAll(table.limit(2))).collect()]
    assert got == [
        "Remove 2 duplicate rows",
        "Consider removing constant columns: ['half', 'one', 'nothing']",
        "Consider dropping or imputing high missing columns",
        "Review mixed data types in column: mix",
    ]
    assert U.quality_issues(table.select("id", "name")).count() == 0


def test_first_values_need_no_full_sort(table):
    plan = U.mixed_types(table, "id", first=100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Sort [" not in plan


def test_duplicate_rows_compare_nested_columns(spark):
    df = spark.sql("SELECT 1 AS a, array(id % 4) AS v, struct(id % 4 AS x, CAST(NULL AS INT) AS y) AS s FROM range(5)")
    assert U.duplicate_rows(df).first()["duplicates"] == 1
    assert U.duplicate_rows(df.select("v")).first()["duplicates"] == 1
