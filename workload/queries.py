"""One query per operator, each over whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableassay.functions.schema import union_all
from tableassay.functions.values import DATE_SEPARATORS, is_number_text
from tableassay.operators import calendar, distributions, quantiles, relational, relations, rules, stats, uplift
from tableassay.plans import sql
from tableassay.plans.profile import Profile, profile_report, target_analysis, target_report
from tableassay.session import scratch_path
from tableassay.sources import auto, catalog, files, sinks, sqlite, synthetic, workbook
from workload import fixtures
from workload.tables import load, rounded

Query = Callable[[SparkSession, str], DataFrame]

PRICED = ["l_quantity", "l_discount", "price", "revenue"]
UNEVEN = ["l_orderkey", "l_linenumber", "quantity", "price", "revenue"]
PRICED_KEY = ["l_orderkey", "l_linenumber"]

SQL_TEXTS = {
    "sql_scan": "SELECT * FROM customer",
    "sql_filter": "SELECT * FROM customer WHERE c_acctbal > 30 AND c_nationkey >= 4",
    "sql_filter_topk": """
        SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
        WHERE c_acctbal > 5000 AND c_nationkey >= 4
        ORDER BY c_acctbal DESC, c_custkey LIMIT 10""",
    "sql_inner_join": """
        SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, o.o_totalprice, o.o_orderpriority
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
        WHERE c.c_mktsegment = 'BUILDING'""",
    "sql_left_join_agg": """
        SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment,
               COUNT(o.o_orderkey) AS order_count,
               round(AVG(o.o_totalprice), 8) AS avg_order,
               round(SUM(o.o_totalprice), 2) AS total_spent
        FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
        GROUP BY c.c_custkey, c.c_acctbal, c.c_mktsegment
        HAVING order_count > 2
        ORDER BY total_spent DESC, c.c_custkey LIMIT 15""",
    "sql_count": "SELECT COUNT(*) AS n FROM lineitem",
    "sql_any": """
        SELECT n_name, o_orderstatus, COUNT(*) AS orders, round(SUM(o_totalprice), 2) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name, o_orderstatus""",
}


def _sql(name: str) -> Query:
    tables = [t for t in ("customer", "orders", "lineitem", "nation") if t in SQL_TEXTS[name].split()]

    def query(spark, sf):
        return sql.run_sql(spark, SQL_TEXTS[name], {t: load(spark, sf, t) for t in tables})

    return query


def _on(table: str, operator: Callable[[DataFrame], DataFrame], *floats: str) -> Query:
    """An operator on one table, its float results rounded."""

    def query(spark, sf):
        out = operator(load(spark, sf, table))
        return rounded(out, *floats) if floats else out

    return query


# sources -------------------------------------------------------------------


def read_csv(spark, sf):
    # some balances are written as the null token NA
    rows = load(spark, sf, "customer").withColumn(
        "c_acctbal", F.expr("IF(c_custkey % 10 = 0, 'NA', CAST(c_acctbal AS STRING))")
    )
    return files.read_csv(spark, fixtures.write_csv(rows))


def read_csv_breaks(spark, sf):
    """Whole texts with line breaks in quotes, cut over many splits, in two orders of columns."""
    path = fixtures.write_csv_texts(load(spark, sf, "documents"))
    return files.read_csv(fixtures.small_splits(spark), path)


def read_json(spark, sf):
    return files.read_json(spark, fixtures.write_json(load(spark, sf, "customer")))


def read_json_forms(spark, sf):
    """Files of three forms, each found by its brackets."""
    paths = fixtures.write_json_forms(load(spark, sf, "customer"), "c_custkey")
    return files.read_json(fixtures.small_splits(spark), paths)


def read_parquet(spark, sf):
    return files.read_parquet(spark, f"{sf}/orders.parquet").where("o_totalprice > 1000").select(
        "o_orderkey", "o_totalprice"
    )


def read_excel(spark, sf):
    rows = load(spark, sf, "customer").withColumn("c_acctbal", F.expr("IF(c_custkey % 10 = 0, NULL, c_acctbal)"))
    return workbook.read_excel(spark, fixtures.write_workbooks(rows))


def _sqlite_database(spark, sf) -> str:
    path = scratch_path(spark, "sqlite")
    for name in ("customer", "orders"):
        sqlite.write_sqlite(load(spark, sf, name), path, name)
    return path


def read_sqlite_table(spark, sf):
    return sqlite.read_sqlite_table(spark, _sqlite_database(spark, sf), "customer")


def read_sqlite_query(spark, sf):
    return sqlite.read_sqlite_query(spark, _sqlite_database(spark, sf), SQL_TEXTS["sql_left_join_agg"])


def explore_database(spark, sf):
    return catalog.explore_database(spark, {t: load(spark, sf, t) for t in ("customer", "orders", "nation")})


def explore_sample(spark, sf):
    return catalog.sample_rows(spark, {"orders": load(spark, sf, "orders")}, "orders", "o_orderkey")


def load_auto(spark, sf):
    """A third of the suppliers by each suffix."""
    rows, folder = load(spark, sf, "supplier"), scratch_path(spark, "auto")
    parts = [rows.where(f"s_suppkey % 3 = {i}") for i in range(3)]
    parts[0].write.option("header", True).csv(f"{folder}/a.csv")
    parts[1].write.json(f"{folder}/b.JSON")
    parts[2].write.parquet(f"{folder}/c.parquet")
    read = [auto.load_auto(spark, f"{folder}/{name}") for name in ("a.csv", "b.JSON", "c.parquet")]
    columns = rows.columns
    return union_all([r.select(columns) for r in read]).withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


def write_table(spark, sf):
    path = scratch_path(spark, "table")
    sinks.write_table(load(spark, sf, "orders"), path, order_by="o_orderkey", index_label="row_id")
    return spark.read.parquet(path).select("row_id", "o_orderkey", "o_totalprice")


def write_report(spark, sf):
    df = load(spark, sf, "labelled")
    folder = scratch_path(spark, "report")
    paths = sinks.write_report({"missing": stats.missing_summary(df), "types": stats.column_types(df)}, folder)
    return rounded(spark.read.parquet(paths[0]), "missing_pct")


# projection, filter, order ---------------------------------------------------


def add_columns(df):
    out = relational.add_columns(df, {"revenue": "l_extendedprice * (1 - l_discount)", "year": "year(l_shipdate)"})
    return out.select("l_orderkey", "l_linenumber", "revenue", "year")


def scalar_functions(df):
    """The functions of single cells that the operators are made of, on every order."""
    first = "substring(o_orderpriority, 1, 1)"
    out = relational.add_columns(
        df,
        {
            "is_missing": "o_orderstatus IS NULL",
            "as_number": f"IF({is_number_text(first)}, CAST({first} AS DOUBLE), NULL)",
            "as_text": "CAST(o_custkey AS STRING)",
            "whole": "CAST(o_totalprice AS BIGINT)",
            "chars": "length(o_orderpriority)",
            "separated": f"o_orderpriority RLIKE '{DATE_SEPARATORS}'",
            "distance": "abs(o_totalprice - 100000)",
            "year": "year(o_orderdate)",
            "month": "month(o_orderdate)",
            "day": "day(o_orderdate)",
            "weekday": "weekday(o_orderdate)",
            "hour": "hour(o_orderdate)",
            "date": "to_date(o_orderdate)",
            "later": "timestampadd(DAY, 30, o_orderdate)",
            "share": "(o_totalprice - 10) * 100 / (o_totalprice + 10)",
        },
    )
    return out.drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


# reports ---------------------------------------------------------------------


def _long(step: str, table: DataFrame) -> DataFrame:
    """``(step, key, metric, value)``: a row per cell that holds a count or a measure,
    under the other cells as key; a table without such cells gives one row per row."""
    keys, metrics = [], []
    for f in table.schema.fields:
        if f.dataType in (T.LongType(), T.DoubleType()):
            metrics += [f"'{f.name}'", f"CAST(`{f.name}` AS DOUBLE)"]
        elif f.dataType in (T.TimestampType(), T.TimestampNTZType()):
            keys.append(f"date_format(`{f.name}`, 'yyyy-MM-dd HH:mm:ss')")
        else:
            keys.append(f"coalesce(CAST(`{f.name}` AS STRING), '')")
    metrics = metrics or ["'rows'", "1D"]
    key = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    cells = f"stack({len(metrics) // 2}, {', '.join(metrics)}) AS (metric, value)"
    return table.selectExpr(f"'{step}' AS step", f"{key} AS key", cells)


def _as_long(tables: dict[str, DataFrame]) -> DataFrame:
    return rounded(union_all([_long(k, t) for k, t in tables.items()]), "value")


def complete_analysis(spark, sf):
    """Every cell of every table of the ten steps."""
    return _as_long(Profile(load(spark, sf, "events")).complete_analysis("value"))


def target_analysis_cells(spark, sf):
    return _as_long(target_analysis(load(spark, sf, "priced"), "revenue"))


def report(spark, sf):
    return rounded(profile_report(load(spark, sf, "events")), "value")


def report_of_numbers(spark, sf):
    return rounded(profile_report(load(spark, sf, "priced")), "value")


def report_with_target(spark, sf):
    return rounded(target_report(load(spark, sf, "orders"), "o_orderstatus"), "value")


# synthetic tables on the given keys --------------------------------------------


def _keyed_customers(spark, sf) -> tuple[DataFrame, int]:
    """Customers by a dense id; the row count is a plain count."""
    customers = load(spark, sf, "customer")
    rows = customers.count()
    return sinks.add_row_key(customers.select("c_custkey"), "c_custkey", "id"), rows


def _sample(spark, sf) -> DataFrame:
    ids, rows = _keyed_customers(spark, sf)
    return synthetic.sample_columns(ids, rows)


def gen_sample(spark, sf):
    """Facts that hold for any draw of the demo columns."""
    return _sample(spark, sf).selectExpr(
        "count(*) AS rows",
        "count(age) AS ages",
        "count_if(income > 0) AS incomes",
        "count_if(score BETWEEN 0 AND 100) AS scores",
        "count_if(category IN ('A', 'B', 'C', 'D')) AS categories",
        "count_if(rating BETWEEN 1 AND 5) AS ratings",
        "min(registration_date) AS first_day",
        "max(registration_date) AS last_day",
        "abs(avg(age) - 35) < 2 AS age_mean_fits",
        "abs(avg(ln(income)) - 10) < 0.15 AS income_mean_fits",
        "abs(avg(score) - 28.57) < 3 AS score_mean_fits",
    )


def inject_nulls(spark, sf):
    sample = _sample(spark, sf)
    out = synthetic.inject_nulls(synthetic.inject_nulls(sample, "id", "income", 0.1), "id", "score", 0.05)
    return out.selectExpr(
        "count(*) AS rows", "count_if(income IS NULL) AS income_gaps", "count_if(score IS NULL) AS score_gaps"
    )


def inject_outliers(spark, sf):
    out = synthetic.inject_outliers(_sample(spark, sf), "id", "age", 0.02)
    return out.selectExpr("count(*) AS rows", "count_if(age IN (120, 150, 200)) AS outliers")


def gen_customers(spark, sf):
    out = synthetic.gen_customers(synthetic.with_sample_gaps(_sample(spark, sf)))
    return out.selectExpr(
        "count(*) AS rows",
        "count(DISTINCT customer_id) AS keys",
        "min(customer_id) AS first_key",
        "max(customer_id) AS last_key",
        "count(income) AS incomes",
    )


def gen_transactions(spark, sf):
    per = (
        synthetic.gen_transactions(_sample(spark, sf))
        .groupBy("customer_id")
        .agg(F.expr("count(1) AS n"), F.expr("min(amount) AS least"))
    )
    return per.selectExpr(
        "count(*) AS customers",
        "min(n) >= 1 AND max(n) <= 5 AS counts_fit",
        "min(least) >= 0 AS amounts_fit",
        "abs(avg(n) - 3) < 0.2 AS mean_fits",
    )


def _outlier_rows(df):
    return relations.outlier_rows(df, "value").select("event_id", "value")


def _boxes(spark, sf):
    out = union_all(
        [
            distributions.box_stats(load(spark, sf, "events"), ["value"]),
            distributions.box_stats(load(spark, sf, "documents"), ["n_chars"]),
        ]
    )
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


def _kde(bins):
    def operator(df):
        out = distributions.kde(df, ["value"], points=1000, bins=bins)
        return out.selectExpr("column", "point", "round(x, 6) + 0.0 AS x", "round(density, 9) + 0.0 AS density")

    return operator


def queries() -> dict[str, Query]:
    labelled = ["n_chars", "quality", "toxic"]
    return {
        # sources and sinks
        "read_csv": read_csv,
        "read_excel": read_excel,
        "read_csv_breaks": read_csv_breaks,
        "read_json": read_json,
        "read_json_forms": read_json_forms,
        "read_parquet": read_parquet,
        "read_sqlite_table": read_sqlite_table,
        "read_sqlite_query": read_sqlite_query,
        "explore_database": explore_database,
        "explore_sample": explore_sample,
        "load_auto": load_auto,
        "write_table": write_table,
        "write_report": write_report,
        # projection, filter, order, limit
        "select_columns": _on("lineitem", lambda d: relational.select_columns(d, ["l_orderkey", "l_quantity"])),
        "filter_predicate": _on(
            "lineitem", lambda d: relational.filter_predicate(d, "l_quantity < 3 OR l_extendedprice > 100000")
        ),
        "filter_result": _on(
            "labelled", lambda d: relational.filter_result(stats.missing_summary(d), "missing", 0), "missing_pct"
        ),
        "drop_nulls": _on("labelled", lambda d: relational.drop_nulls(d, "quality")),
        "head": _on("orders", lambda d: relational.head(d, "o_orderkey", 10)),
        "sort_values": _on(
            "priced",
            lambda d: relational.sort_values(
                relations.correlation_matrix(d, PRICED), "r", absolute=True, tie=["feature_1", "feature_2"]
            ),
            "r",
        ),
        "scalar_functions": _on("orders", scalar_functions, "distance", "share"),
        "add_columns": _on("lineitem", add_columns, "revenue"),
        # SQL pass-through
        **{name: _sql(name) for name in SQL_TEXTS},
        # schema
        "column_types": _on("events", stats.column_types),
        "class_counts": _on("events", stats.class_counts),
        "shape": _on("lineitem", stats.shape),
        "column_footprint": _on("labelled", stats.column_footprint),
        # column profile
        "missing_summary": _on("labelled", stats.missing_summary, "missing_pct"),
        "missing_nonzero": _on("labelled", stats.missing_nonzero),
        "distinct_counts": _on("lineitem", stats.distinct_counts),
        "describe": _on("priced", lambda d: stats.describe(d, PRICED), "value"),
        "skewness": _on("labelled", lambda d: stats.skewness(d, labelled), "skewness"),
        "kurtosis": _on("labelled", lambda d: stats.kurtosis(d, labelled), "kurtosis"),
        "variance": _on("lineitem", stats.variance, "variance"),
        "quantiles": _on(
            "lineitem", lambda d: quantiles.quantiles(d, stats.numeric_columns(d), [0.01, 0.1, 0.5, 0.9, 0.99]), "value"
        ),
        "statistical_summary": _on("lineitem", stats.statistical_summary, "value"),
        # distributions
        "null_pattern": _on("labelled", distributions.null_pattern),
        "null_blocks": _on("labelled", lambda d: distributions.null_blocks(d, "doc_id"), "missing_pct"),
        "histogram_density": _on(
            "lineitem", distributions.histogram_density, "lower", "upper", "density"
        ),
        "histogram_count": _on("events", lambda d: distributions.histogram_count(d, "value"), "lower", "upper"),
        "kde": _on("events", _kde(None)),
        "kde_binned": _on("events", _kde(4096)),
        "value_counts_topn": _on("documents", lambda d: distributions.value_counts_topn(d, ["lang", "source", "text"])),
        "value_counts": _on("orders", lambda d: distributions.value_counts(d, "o_orderpriority")),
        "proportions": _on("orders", lambda d: distributions.proportions(d, "o_orderstatus"), "pct"),
        "box_stats": _boxes,
        "scatter_points": _on(
            "priced", lambda d: relations.scatter_points(d, "revenue", PRICED, points=200, key=PRICED_KEY)
        ),
        "scatter_grid": _on(
            "priced", lambda d: relations.scatter_grid(d, "revenue", PRICED, bins=20), "x_low", "y_low"
        ),
        # relations and outliers
        "correlation_matrix": _on("priced", lambda d: relations.correlation_matrix(d, PRICED), "r"),
        "correlation_uneven": _on("uneven", lambda d: relations.correlation_matrix(d, UNEVEN), "r"),
        "high_correlations": _on("priced", lambda d: relations.high_correlations(d, PRICED), "r"),
        "correlation_lower_triangle": _on("lineitem", relations.correlation_lower_triangle, "r"),
        "outlier_detection": _on("events", relations.outlier_detection, "outlier_pct"),
        "outlier_rows": _on("events", _outlier_rows),
        "target_distribution": _on("lineitem", lambda d: relations.target_distribution(d, "l_extendedprice"), "value"),
        "target_distribution_categorical": _on("orders", lambda d: relations.target_distribution(d, "o_orderstatus")),
        "target_correlation": _on("priced", lambda d: relations.target_correlation(d, "revenue"), "abs_r"),
        "target_top_features": _on("priced", lambda d: relations.target_top_features(d, "revenue"), "abs_r"),
        # rules
        "highly_skewed": _on("labelled", rules.highly_skewed, "metric"),
        "high_cardinality": _on("documents", rules.high_cardinality, "metric"),
        "date_candidates": _on("dated", lambda d: rules.date_candidates(d)),
        "date_candidates_full": _on("dated", lambda d: rules.date_candidates(d)),
        "feature_insights": _on("dated", lambda d: rules.feature_insights(d)),
        "duplicate_rows": _on("documents", lambda d: rules.duplicate_rows(d, ["text"]), "duplicate_pct"),
        "duplicate_rows_nested": _on("embeddings", lambda d: rules.duplicate_rows(d, ["embedding"]), "duplicate_pct"),
        "duplicate_rows_whole": _on("messy", lambda d: rules.duplicate_rows(d), "duplicate_pct"),
        "constant_columns": _on("messy", rules.constant_columns),
        "high_missing": _on("labelled", rules.high_missing, "metric"),
        "mixed_types": _on("messy", lambda d: rules.mixed_types(d)),
        "mixed_types_full": _on("messy", lambda d: rules.mixed_types(d)),
        "quality_issues": _on("messy", lambda d: rules.quality_issues(d)),
        # dates
        "date_range": _on("events", calendar.date_range),
        "calendar_features": _on("events", lambda d: calendar.calendar_features(d.select("event_id", "ts"), "ts")),
        "daily_counts": _on("events", calendar.daily_counts),
        "monthly_pattern": _on("lineitem", calendar.monthly_pattern),
        "weekday_pattern": _on("orders", calendar.weekday_pattern),
        "hourly_pattern": _on("events", calendar.hourly_pattern),
        # workflows and reports
        "basic_info": _on("labelled", stats.basic_info, "missing_pct"),
        "target_analysis": target_analysis_cells,
        "complete_analysis": complete_analysis,
        "profile_report": report,
        "profile_report_numbers": report_of_numbers,
        "target_report": report_with_target,
        "uplift_summary": _on("experiment", uplift.uplift_summary, "lift"),
        # synthetic data
        "gen_sample": gen_sample,
        "inject_nulls": inject_nulls,
        "inject_outliers": inject_outliers,
        "gen_customers": gen_customers,
        "gen_transactions": gen_transactions,
    }
