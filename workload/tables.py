"""Input tables and derived inputs; the SQL is read by both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableassay.plans.sql import run_sql

DERIVED = {
    # gaps in one column, and a strong correlation
    "priced": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
               CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice END AS price,
               l_extendedprice * (1 - l_discount) AS revenue
        FROM lineitem""",
    # a gap in most rows, and cells that are not finite
    "uneven": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS quantity,
               CASE WHEN l_partkey % 2 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE l_extendedprice END AS price,
               CASE WHEN l_suppkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice * (1 - l_discount) END AS revenue
        FROM lineitem""",
    # the same with gaps only
    "uneven_finite": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_orderkey % 3 = 0 OR l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
               CASE WHEN l_partkey % 2 = 0 OR l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS revenue
        FROM lineitem""",
    # most labels are missing
    "labelled": """
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # text that looks like dates
    "dated": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS STRING) AS day_text
        FROM orders""",
    # copies, a constant, an empty column, numbers among names
    "messy": """
        SELECT c_custkey, c_mktsegment, 'x' AS same, CAST(NULL AS DOUBLE) AS nothing,
               CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE c_name END AS code
        FROM customer
        UNION ALL
        SELECT c_custkey, c_mktsegment, 'x' AS same, CAST(NULL AS DOUBLE) AS nothing,
               CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE c_name END AS code
        FROM customer WHERE c_custkey % 7 = 0""",
    # an experiment read off the orders: urgent ones against the rest, per nation
    "experiment": """
        SELECT geo, treatment, control, CAST(NULL AS DOUBLE) AS lift,
               treatment / control - 1 - 1.96 * se AS ci_low,
               treatment / control - 1 + 1.96 * se AS ci_high,
               2 / (1 + exp(1.5976 * z + 0.070565 * z * z * z)) AS p_value
        FROM (SELECT *, abs(treatment / control - 1) / se AS z
              FROM (SELECT geo, treatment, control,
                           sqrt(treatment_var / treatment_n + control_var / control_n) / control AS se
                    FROM (SELECT n_name AS geo,
                                 avg(CASE WHEN urgent THEN o_totalprice END) AS treatment,
                                 avg(CASE WHEN NOT urgent THEN o_totalprice END) AS control,
                                 var_samp(CASE WHEN urgent THEN o_totalprice END) AS treatment_var,
                                 var_samp(CASE WHEN NOT urgent THEN o_totalprice END) AS control_var,
                                 count(CASE WHEN urgent THEN 1 END) AS treatment_n,
                                 count(CASE WHEN NOT urgent THEN 1 END) AS control_n
                          FROM (SELECT n_name, o_totalprice, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent
                                FROM orders JOIN customer ON o_custkey = c_custkey
                                JOIN nation ON c_nationkey = n_nationkey)
                          GROUP BY n_name)))""",
}

_INPUTS = {
    "priced": ["lineitem"],
    "uneven": ["lineitem"],
    "uneven_finite": ["lineitem"],
    "labelled": ["documents", "labels"],
    "dated": ["orders"],
    "messy": ["customer"],
    "experiment": ["orders", "customer", "nation"],
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in DERIVED:
        return run_sql(spark, DERIVED[name], {t: load(spark, sf_dir, t) for t in _INPUTS[name]})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(name: str) -> str:
    """A FROM item for plain SQL."""
    return f"({DERIVED[name]}) AS {name}" if name in DERIVED else name


def stable(sql: str) -> str:
    """Round off the last digits, so that the order of summation does not show.

    Means of amounts in cents end after seven decimals at sf0.01; rounding any
    shorter would meet exact halves.
    """
    return (
        f"(CASE WHEN abs({sql}) < 1e3 THEN round({sql}, 9) WHEN abs({sql}) < 1e6 THEN round({sql}, 7) "
        f"WHEN abs({sql}) < 1e9 THEN round({sql}, 2) ELSE round({sql}, 0) END + 0.0)"
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(*[f"CAST({stable(c)} AS DOUBLE) AS {c}" if c in names else f"`{c}`" for c in df.columns])
