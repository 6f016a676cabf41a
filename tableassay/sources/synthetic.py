"""Synthetic demo tables, drawn per row from hashes of a row id.

Values depend only on the id and the seed, never on partitioning, so a task
that is run again yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableassay.functions.schema import quoted, text

# Fixed values of the demo tables.
CATEGORIES = (("A", 0.4), ("B", 0.3), ("C", 0.2), ("D", 0.1))
CITIES = ("New York", "Los Angeles", "Chicago", "Houston", "Phoenix")
RATINGS = ((1, 0.05), (2, 0.1), (3, 0.3), (4, 0.35), (5, 0.2))
PREMIUM_SHARE = 0.3
FIRST_DAY, LAST_DAY = "2020-01-01 00:00:00", "2023-12-31 00:00:00"
PRODUCT_CATEGORIES = ("Electronics", "Clothing", "Books", "Home", "Sports")
OUTLIER_AGES = (120, 150, 200)

_BLOCK = 10_000  # rows per block when an exact share is drawn


def uniform(id_sql: str, stream: str, seed: int) -> str:
    """SQL of a uniform number in [0, 1) for an id and a named stream."""
    return f"(shiftrightunsigned(xxhash64({id_sql}, {text(stream)}, {seed}), 11) * {2.0**-53!r}D)"


def normal(id_sql: str, stream: str, seed: int) -> str:
    u, v = uniform(id_sql, stream + "/r", seed), uniform(id_sql, stream + "/a", seed)
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"


def weighted(u: str, choices) -> str:
    """SQL of a choice by cumulative weight."""
    upto, cases = 0.0, []
    for value, weight in choices[:-1]:
        upto += weight
        cases.append(f"WHEN {u} < {upto:.6f}D THEN {value!r}")
    return f"CASE {' '.join(cases)} ELSE {choices[-1][0]!r} END"


def one_of(u: str, values) -> str:
    listed = ", ".join(repr(v) for v in values)
    return f"get(array({listed}), CAST({u} * {len(values)} AS INT))"


def sample_columns(ids: DataFrame, rows: int, id_column: str = "id", seed: int = 42) -> DataFrame:
    """The demo columns added to rows that hold a dense id 0 .. ``rows`` - 1."""
    i = quoted(id_column)

    def u(stream: str) -> str:
        return uniform(i, stream, seed)

    # the second smallest of six uniform numbers follows beta(2, 5)
    six = ", ".join(u(f"score{k}") for k in range(6))
    span = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{FIRST_DAY}', TIMESTAMP_NTZ'{LAST_DAY}')"
    steps = max(rows - 1, 1)
    return ids.selectExpr(
        "*",
        f"CAST(35 + 12 * {normal(i, 'age', seed)} AS INT) AS age",
        f"exp(10 + 0.8D * {normal(i, 'income', seed)}) AS income",
        f"100 * element_at(array_sort(array({six})), 2) AS score",
        f"{weighted(u('category'), CATEGORIES)} AS category",
        f"{one_of(u('city'), CITIES)} AS city",
        f"{u('premium')} < {PREMIUM_SHARE}D AS is_premium",
        f"timestampadd(MICROSECOND, CAST({i} * ({span} / {steps}D) AS BIGINT), TIMESTAMP_NTZ'{FIRST_DAY}') "
        "AS registration_date",
        f"{weighted(u('rating'), RATINGS)} AS rating",
    )


def mark_share(df: DataFrame, id_column: str, share: float, flag: str, seed: int = 42) -> DataFrame:
    """A flag on exactly ``floor(share * rows)`` random rows of a dense 0-based id.

    Ids are cut into blocks, each with its own quota; the quotas add up to the
    exact total.  Work per task is one block, never the whole table.
    """
    i = quoted(id_column)
    block = f"({i} DIV {_BLOCK})"
    start, end = f"({block} * {_BLOCK})", f"({block} * {_BLOCK} + count(1) OVER (PARTITION BY {block}))"
    quota = f"(floor({end} * {share}D) - floor({start} * {share}D))"
    place = f"row_number() OVER (PARTITION BY {block} ORDER BY xxhash64({i}, {text(flag)}, {seed}), {i})"
    return df.selectExpr("*", f"{place} <= {quota} AS {quoted(flag)}")


def inject_nulls(df: DataFrame, id_column: str, column: str, share: float, seed: int = 42) -> DataFrame:
    """Exactly the given share of a column set missing, at random."""
    c = quoted(column)
    marked = mark_share(df, id_column, share, "_gap", seed + len(column))
    return marked.withColumn(column, F.expr(f"IF(_gap, NULL, {c})")).drop("_gap")


def inject_outliers(df: DataFrame, id_column: str, column: str, share: float, values=OUTLIER_AGES, seed: int = 42) -> DataFrame:
    """Exactly the given share of a column replaced by extreme values."""
    marked = mark_share(df, id_column, share, "_far", seed)
    value = one_of(uniform(quoted(id_column), "outlier", seed), values)
    cast = df.schema[column].dataType.simpleString()
    return marked.withColumn(column, F.expr(f"IF(_far, CAST({value} AS {cast}), {quoted(column)})")).drop("_far")


def with_sample_gaps(df: DataFrame, id_column: str = "id", seed: int = 42) -> DataFrame:
    """10 % of income and 5 % of score missing, 2 % of age far out."""
    out = inject_nulls(df, id_column, "income", 0.1, seed)
    out = inject_nulls(out, id_column, "score", 0.05, seed)
    return inject_outliers(out, id_column, "age", 0.02, seed=seed)


def gen_sample(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """The demo table of ``n`` rows with its row id."""
    return with_sample_gaps(sample_columns(spark.range(n), n, "id", seed), "id", seed)


def gen_customers(sample: DataFrame, id_column: str = "id") -> DataFrame:
    """Customers: the demo table without its date, keyed from 0."""
    names = ["age", "income", "score", "category", "city", "is_premium", "rating"]
    return sample.selectExpr(f"{quoted(id_column)} AS customer_id", *names)


def gen_transactions(sample: DataFrame, id_column: str = "id", seed: int = 42) -> DataFrame:
    """One to five purchases per row of the demo table.

    ``transaction_id`` is dense only after ``add_row_key`` by ``customer_id, n``.
    """
    i = quoted(id_column)
    many = f"CAST(1 + floor({uniform(i, 'count', seed)} * 5) AS INT)"
    rows = sample.selectExpr(
        f"{i} AS customer_id", "registration_date", f"explode(sequence(1, {many})) AS n"
    ).selectExpr("*", "customer_id * 8 + n AS _t")
    return rows.selectExpr(
        "customer_id",
        "n",
        f"timestampadd(DAY, CAST(floor({uniform('_t', 'day', seed)} * 365) AS INT), registration_date) AS transaction_date",
        f"-100 * ln(1 - {uniform('_t', 'amount', seed)}) AS amount",
        f"{one_of(uniform('_t', 'product', seed), PRODUCT_CATEGORIES)} AS product_category",
    )


def create_sample_database(spark: SparkSession, path: str, n: int = 1000, seed: int = 42) -> str:
    """Write customers and transactions as a SQLite database folder."""
    from tableassay.sources.sinks import add_row_key, write_table

    sample = gen_sample(spark, n, seed)
    write_table(gen_customers(sample), path, format="sqlite", table="customers")
    keyed = add_row_key(gen_transactions(sample, seed=seed), ["customer_id", "n"], "transaction_id").drop("n")
    write_table(keyed, path, format="sqlite", table="transactions")
    return path
