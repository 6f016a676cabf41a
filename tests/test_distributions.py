import numpy as np
import pytest

from tableassay.operators import distributions as D


def test_histogram_matches_numpy(spark, lineitem, by):
    data = lineitem.toPandas()
    got = by(D.histogram_density(lineitem, ["l_quantity", "l_extendedprice", "l_orderkey"]), "column", "bin")
    for c in ("l_quantity", "l_extendedprice", "l_orderkey"):
        counts, edges = np.histogram(data[c], bins=30)
        density, _ = np.histogram(data[c], bins=30, density=True)
        for b in range(30):
            r = got[c, b]
            assert r["count"] == counts[b]
            assert r["lower"] == pytest.approx(edges[b]) and r["upper"] == pytest.approx(edges[b + 1])
            assert r["density"] == pytest.approx(density[b])


def test_histogram_edges_and_constant(spark):
    # values that lie exactly on edges
    df = spark.range(31).selectExpr("CAST(id + 1 AS DOUBLE) AS x")
    assert [r["count"] for r in D.histogram_count(df, "x").orderBy("bin").collect()] == list(
        np.histogram(np.arange(1.0, 32), bins=30)[0]
    )
    flat = D.histogram_count(spark.sql("SELECT 5D AS x FROM range(4)"), "x", bins=10).orderBy("bin").collect()
    assert flat[0]["lower"] == 4.5 and flat[-1]["upper"] == 5.5
    assert [r["count"] for r in flat] == list(np.histogram([5.0] * 4, bins=10)[0])


def test_histogram_of_missing_column(gappy):
    assert D.histogram_density(gappy, ["nothing"]).count() == 0
    assert D.histogram_density(gappy, ["x"]).agg({"count": "sum"}).first()[0] == gappy.where("x IS NOT NULL AND NOT isnan(x)").count()


def density(values, points):
    values = np.asarray(values, dtype=float)
    h = values.std(ddof=1) * len(values) ** -0.2
    lo, hi = values.min(), values.max()
    x = np.linspace(lo - 0.5 * (hi - lo), hi + 0.5 * (hi - lo), points)
    z = (x[:, None] - values[None, :]) / h
    return x, np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))


def test_kde_is_the_full_sum(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("value")
    x, want = density([r[0] for r in df.collect()], 200)
    got = D.kde(df, ["value"], points=200).orderBy("point").collect()
    assert np.allclose([r["x"] for r in got], x)
    assert np.allclose([r["density"] for r in got], want, rtol=1e-9, atol=1e-300)
    binned = D.kde(df, ["value"], points=200, bins=4096).orderBy("point").collect()
    assert np.allclose([r["density"] for r in binned], want, atol=want.max() * 1e-3)


def test_kde_far_outlier(spark):
    # most grid points see no value at all
    df = spark.sql("SELECT IF(id = 0, 1e6D, id * 1D) AS x FROM range(2000)")
    x, want = density([1e6] + list(range(1, 2000)), 300)
    got = [r["density"] for r in D.kde(df, ["x"], points=300).orderBy("point").collect()]
    assert len(got) == 300 and np.allclose(got, want, rtol=1e-9, atol=1e-300)


def test_kde_kernel_narrower_than_grid(spark):
    df = spark.sql("SELECT IF(id = 0, 1e9D, id * 1D) AS x FROM range(5000)")
    x, want = density([1e9] + list(range(1, 5000)), 11)
    got = [r["density"] for r in D.kde(df, ["x"], points=11).orderBy("point").collect()]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-300)


def test_kde_constant_column_has_none(gappy):
    assert D.kde(gappy, ["same", "nothing"], points=50).count() == 0


def test_topn_breaks_ties_by_value(spark):
    df = spark.sql("SELECT concat('k', id % 20) AS k FROM range(40)")
    got = [r["value"] for r in D.value_counts_topn(df, top_n=3).collect()]
    assert got == ["k0", "k1", "k10"]


def test_value_counts_and_proportions(gappy, by):
    want = gappy.toPandas()["word"].value_counts()
    got = by(D.value_counts(gappy, "word"))
    assert {k: r["count"] for k, r in got.items()} == want.to_dict()
    share = by(D.proportions(gappy, "word"))
    assert sum(r["pct"] for r in share.values()) == pytest.approx(100)
    assert share["v1"]["pct"] == pytest.approx(want["v1"] / want.sum() * 100)


def test_topn_plan_keeps_a_heap_per_task(lineitem):
    plan = D.value_counts_topn(lineitem)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and plan.count("WindowGroupLimit") >= 2


def test_null_pattern(spark):
    df = spark.sql("SELECT IF(id < 3, NULL, id) AS a, IF(id < 5, double('NaN'), 1D) AS b, 1 AS c FROM range(10)")
    got = {r["missing_columns"]: r["rows"] for r in D.null_pattern(df).collect()}
    assert got == {"a,b": 3, "b": 2, "": 5}


def test_null_blocks(spark, by):
    df = spark.sql("SELECT id, IF(id < 50, NULL, id) AS a FROM range(100)")
    got = by(D.null_blocks(df, "id", blocks=4), "block", "column")
    assert [got[b, "a"]["missing"] for b in range(4)] == [25, 25, 0, 0]
    assert got[0, "a"]["missing_pct"] == 100.0


def test_box_stats(spark):
    df = spark.sql("SELECT CAST(id AS DOUBLE) AS x FROM range(1, 10) UNION ALL SELECT 100D UNION ALL SELECT NULL")
    r = D.box_stats(df).first()
    values = np.array([*range(1, 10), 100.0])
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    assert (r["q1"], r["median"], r["q3"]) == (q1, med, q3)
    assert (r["whisker_low"], r["whisker_high"], r["fliers"]) == (1.0, 9.0, 1)


def test_histogram_of_infinite_values_and_large_constants(spark):
    df = spark.sql("SELECT IF(id = 3, double('Infinity'), IF(id = 4, -double('Infinity'), id * 1D)) AS x, 1e17D AS c FROM range(50)")
    got = {r["bin"]: r for r in D.histogram_density(df, ["x"], bins=7).collect()}
    assert sorted(got) == list(range(-1, 8)) and got[-1]["count"] == got[7]["count"] == 1
    data = np.array([v for v in range(50) if v not in (3, 4)], float)
    counts, edges = np.histogram(data, bins=7)
    density, _ = np.histogram(data, bins=7, density=True)
    assert [got[i]["count"] for i in range(7)] == list(counts) and got[0]["lower"] == edges[0] and got[6]["upper"] == edges[-1]
    assert [got[i]["density"] for i in range(7)] == pytest.approx(list(density))
    flat = D.histogram_density(df, ["c"], bins=30).collect()
    assert len(flat) == 30 and sum(r["count"] for r in flat) == 50
    assert all(r["upper"] > r["lower"] for r in flat)
    densities = D.kde(df, ["x", "c"], points=50).collect()
    assert {r["column"] for r in densities} == {"x"} and all(r["density"] >= 0 for r in densities)


def test_box_stats_aggregates_hash_rows(spark, lineitem):
    plan = D.box_stats(lineitem, ["l_quantity"])._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan


def test_histogram_plan_scans_little(lineitem):
    plan = D.histogram_density(lineitem)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4


def test_top_values_of_long_texts(spark):
    begin = "the same beginning of more than sixty-four characters in every text of this kind: "
    texts = [begin + "b", begin + "a", begin + "b", "#short", "=x", "#short", "=x", "=x", "é" * 64, "é" * 65, None, ""]
    df = spark.createDataFrame([(t, len(t or "") > 60) for t in texts], "t string, flag boolean").repartition(5)
    got = [(r["value"], r["count"]) for r in D.value_counts_topn(df, ["t"], 3).collect()]
    assert got == [("=x", 3), ("#short", 2), (begin + "b", 2)]
    every = {(r["column"], r["value"]): r["count"] for r in D.value_counts_topn(df, top_n=20).collect()}
    assert every == {("t", t): texts.count(t) for t in texts if t is not None} | {("flag", "true"): 5, ("flag", "false"): 7}


def test_no_text_is_shuffled_for_top_values(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = D.value_counts_topn(docs, ["text"])._jdf.queryExecution().executedPlan().toString()
    # texts pass one exchange, behind the join with the winners
    assert plan.count("FileScan") <= 3 and "hashpartitioning(text" not in plan
