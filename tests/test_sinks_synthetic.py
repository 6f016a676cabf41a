import os

import pytest

from tableassay import Profile, add_row_key, read_sqlite_query, run_sql, write_report, write_table
from tableassay.operators import relational, stats
from tableassay.sources import catalog, synthetic


def test_row_key_is_dense_and_ordered(spark):
    # a third of the rows share one key, and copies exist
    df = spark.sql("SELECT IF(id % 3 = 0, 5, id % 1000) AS k, id % 2 AS v FROM range(20000)")
    keyed = add_row_key(df, "k", "row_id", partitions=13)
    assert keyed.columns == ["row_id", "k", "v"]
    got = [(r[0], r[1]) for r in keyed.orderBy("row_id").select("row_id", "k").collect()]
    assert [i for i, _ in got] == list(range(20000))
    keys = [k for _, k in got]
    assert keys == sorted(keys)


def test_write_table_and_report(spark, tmp_path, gappy):
    target = str(tmp_path / "t")
    for n in (20, 30):
        write_table(spark.range(n), target, order_by="id", index_label="i")
    assert spark.read.parquet(target).count() == 30
    with pytest.raises(ValueError):
        write_table(spark.range(3), target, index_label="i")
    write_table(spark.range(4), "kept", format="table")
    write_table(spark.range(6), "kept", format="table")
    assert spark.table("kept").count() == 6
    spark.sql("DROP TABLE kept")
    paths = write_report({"missing": stats.missing_summary(gappy)}, str(tmp_path / "report"), "json")
    assert spark.read.json(paths[0]).count() == len(gappy.columns)


def test_a_table_replaces_itself_and_a_failed_write_leaves_it(spark, tmp_path):
    target = str(tmp_path / "t")
    shared = spark.conf.get("spark.checkpoint.dir")
    staged = lambda: {f for f in os.listdir(shared) if f.startswith("row-key")}
    before = staged()
    write_table(spark.range(10), target, order_by="id", index_label="i")
    write_table(spark.read.parquet(target).where("id > 3").drop("i"), target, order_by="id", index_label="i")
    assert [tuple(r) for r in spark.read.parquet(target).orderBy("i").collect()] == [(k, k + 4) for k in range(6)]
    bad = spark.read.parquet(target).selectExpr("IF(id > 6, raise_error('no'), id) AS id")
    for more in ({}, {"order_by": "id", "index_label": "i"}):
        with pytest.raises(Exception, match="no"):
            write_table(bad, target, **more)
    assert spark.read.parquet(target).count() == 6
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["t"]
    assert staged() == before


def test_a_catalog_table_replaces_itself(spark):
    for name in ("swapped", "`swap ped`"):
        name = name.replace(" ", "_")
        write_table(spark.range(8), name, format="table")
        write_table(spark.table(name).where("id < 5"), name, format="table")
        assert spark.table(name).count() == 5
        with pytest.raises(Exception, match="no"):
            write_table(spark.table(name).selectExpr("raise_error('no') AS id"), name, format="table")
        assert spark.table(name).count() == 5
    left = {t.name for t in spark.catalog.listTables() if t.name.startswith("swap")}
    assert left == {"swapped", "swap_ped"}
    for name in left:
        spark.sql(f"DROP TABLE {name}")


def test_sample_table(spark):
    n = 25_007
    df = synthetic.gen_sample(spark, n).cache()
    r = df.selectExpr(
        "count(*) AS n", "count(DISTINCT id) AS ids", "count_if(income IS NULL) AS i", "count_if(score IS NULL) AS s",
        "count_if(age IN (120, 150, 200)) AS far", "avg(score) AS score", "var_samp(score) AS score_var",
        "avg(ln(income)) AS income", "stddev(ln(income)) AS income_std", "avg(IF(age < 110, age, NULL)) AS age",
        "stddev(IF(age < 110, age, NULL)) AS age_std", "avg(CAST(is_premium AS INT)) AS premium",
        "avg(CAST(category = 'A' AS INT)) AS a", "avg(CAST(rating = 4 AS INT)) AS four", "count(DISTINCT city) AS cities",
    ).first()
    assert (r["n"], r["ids"], r["i"], r["s"], r["far"]) == (n, n, int(0.1 * n), int(0.05 * n), int(0.02 * n))
    assert r["score"] == pytest.approx(28.57, abs=0.4) and r["score_var"] == pytest.approx(255, rel=0.05)
    assert r["income"] == pytest.approx(10, abs=0.03) and r["income_std"] == pytest.approx(0.8, rel=0.03)
    assert r["age"] == pytest.approx(34.5, abs=0.4) and r["age_std"] == pytest.approx(12, rel=0.05)
    assert r["premium"] == pytest.approx(0.3, abs=0.02) and r["a"] == pytest.approx(0.4, abs=0.02)
    assert r["four"] == pytest.approx(0.35, abs=0.02) and r["cities"] == 5
    again = synthetic.sample_columns(spark.range(n).repartition(3), n)
    same = synthetic.sample_columns(spark.range(n), n)
    assert again.exceptAll(same).count() == 0


def test_sample_database(spark, tmp_path):
    path = synthetic.create_sample_database(spark, str(tmp_path / "db"), 300)
    rows = {(r["table"], r["column"]): r["rows"] for r in catalog.explore_database(spark, path).collect()}
    assert rows["customers", "customer_id"] == 300 and 300 <= rows["transactions", "transaction_id"] <= 1500
    keys = read_sqlite_query(spark, path, "SELECT min(transaction_id) AS a, max(transaction_id) AS b, count(*) AS n FROM transactions").first()
    assert keys["a"] == 0 and keys["b"] == keys["n"] - 1
    joined = read_sqlite_query(
        spark, path, "SELECT c.city, t.amount FROM customers c JOIN transactions t ON c.customer_id = t.customer_id WHERE c.is_premium = 1"
    )
    assert joined.count() > 0


def test_run_sql_restores_views(spark):
    spark.range(3).createOrReplaceTempView("kept_view")
    out = run_sql(spark, "SELECT count(*) AS n FROM kept_view JOIN other ON true", {"kept_view": spark.range(5), "other": spark.range(2)})
    assert out.first()["n"] == 10
    assert spark.table("kept_view").count() == 3 and not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("kept_view")


def test_relational(spark, gappy):
    assert relational.select_columns(gappy, ["x", "id"]).columns == ["x", "id"]
    assert relational.drop_nulls(gappy, "x").count() == gappy.toPandas()["x"].notna().sum()
    assert [r["id"] for r in relational.head(gappy, "id", 3).collect()] == [0, 1, 2]
    df = spark.createDataFrame([(-3,), (1,), (2,)], "v int")
    assert [r["v"] for r in relational.sort_values(df, "v", absolute=True).collect()] == [-3, 2, 1]
    assert [r["v"] for r in relational.sort_values(df, "v", descending=False).collect()] == [-3, 1, 2]


def test_profile(spark, gappy, sf_dir):
    with pytest.raises(ValueError):
        Profile(None)
    assert Profile.load(spark, f"{sf_dir}/orders.parquet").datetime_columns == ["o_orderdate"]
    p = Profile(gappy)
    steps = p.complete_analysis("id")
    assert "target_correlation" in steps and "target_correlation" not in p.complete_analysis("absent")
    for name, df in steps.items():
        assert df.collect() is not None, name
    assert set(p.target_analysis("word")) == {"target_distribution", "target_proportions"}
    report = p.profile_report()
    sections = {r[0] for r in report.select("section").distinct().collect()}
    assert sections == {"overview", "missing", "variables", "statistics", "histogram", "frequent", "correlation"}
    assert p.target_report("absent").count() == report.count()
    assert p.target_report("flag").where("section = 'target'").count() == 2
    assert Profile(gappy, exact=False).statistical_summary().count() == 55


def test_quartiles_are_scanned_once(spark, lineitem):
    p = Profile(lineitem)
    scans = lambda df: str(df._jdf.queryExecution().optimizedPlan()).count("] parquet")
    assert scans(p.box_stats()) == 1 and scans(p.outlier_detection()) <= 2
    assert p.statistical_summary().where("stat IN ('25%', '50%', '75%')").count() == 24
    assert scans(stats.basic_info(lineitem)) == 2


def test_boolean_frequencies(gappy):
    got = {(r["column"], r["value"]): r["count"] for r in Profile(gappy).categorical_distributions().collect()}
    assert got["flag", "true"] == got["flag", "false"] == 25


def test_profile_without_numbers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    for name, out in Profile(df).complete_analysis("t").items():
        assert out.collect() is not None, name
    assert Profile(df).profile_report().where("section = 'statistics'").count() == 0
