"""Remote databases, read through Spark's own connectors.

The remote server runs a pushed ``query`` itself; a ``table`` read takes
pushed filters and pruned columns, and splits over ``partition_column`` with
given bounds, or over ``split_by`` into parts of about as many rows each.
Driver jars come with the cluster (``spark.jars``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableassay.functions.schema import quoted

# Default ports.
MYSQL_PORT = 3306
POSTGRESQL_PORT = 5432


def _quote_path(table: str, mark: str) -> str:
    """Quote each part of ``schema.table``; parts that are quoted already stay."""
    parts = []
    for part in table.split("."):
        bare = part[1:-1] if len(part) > 1 and part[0] == part[-1] == mark else part
        parts.append(mark + bare.replace(mark, mark * 2) + mark)
    return ".".join(parts)


def _source(table: str | None, query: str | None, mark: str | None) -> dict[str, str]:
    """Reader option for a query, or else for a table."""
    if query:
        return {"query": query}
    if table:
        return {"dbtable": _quote_path(table, mark) if mark else table}
    raise ValueError("either 'table' or 'query' must be given")


def jdbc_options(
    url: str,
    username: str | None = None,
    password: str | None = None,
    table: str | None = None,
    query: str | None = None,
    *,
    quote: str | None = '"',
    partition_column: str | None = None,
    lower_bound=None,
    upper_bound=None,
    num_partitions: int | None = None,
    **options,
) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``; credentials never enter the URL."""
    out = {"url": url, **_source(table, query, quote), **{k: str(v) for k, v in options.items()}}
    if username is not None:
        out["user"] = username
    if password is not None:
        out["password"] = password
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        if "query" in out:
            # Spark splits table reads only; the query becomes a derived table
            out["dbtable"] = f"({out.pop('query')}) q"
        out.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    return out


_SPLITS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _literal(value) -> str:
    """A cut as SQL of any database."""
    return str(value) if isinstance(value, (int, float, Decimal)) else f"'{value}'"


def equal_depth_predicates(probe: DataFrame, column: str, parts: int, mark: str = '"', accuracy: int = 10_000) -> list[str]:
    """Conditions on a column, each of about as many rows; every row meets exactly one.

    Cuts are quantiles from one mergeable sketch over ``probe``, off by at
    most a share 1/``accuracy`` of the rows.  Equal cuts merge, so a frequent
    value gives fewer, larger parts; NULL goes with the first.  Texts are
    refused: databases sort them in other orders than Spark.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    kind = probe.schema[column].dataType
    if not isinstance(kind, _SPLITS):
        raise TypeError(f"{column} is {kind.simpleString()}: split by a number, date or timestamp")
    name = mark + column.replace(mark, mark * 2) + mark
    cell = F.col(quoted(column))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # NaN and infinities are no cuts; they fall into the first and last parts
        cell = F.when(F.abs(cell) < float("inf"), cell)
    shares = [i / parts for i in range(1, parts)]
    found = probe.agg(F.percentile_approx(cell, shares, accuracy).alias("cuts")).first()["cuts"] if shares else []
    cuts = [_literal(c) for c in sorted(set(found or []))]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"({name} < {cuts[0]} OR {name} IS NULL)", *inner, f"{name} >= {cuts[-1]}"]


def _load(spark: SparkSession, options: dict[str, str], split_by: str | None, parts: int | None, mark: str | None) -> DataFrame:
    if split_by is None:
        return spark.read.format("jdbc").options(**options).load()
    if parts is None or "partitionColumn" in options:
        raise ValueError("split_by needs parts, and no partition_column")
    if "query" in options:
        options["dbtable"] = f"({options.pop('query')}) q"
    # the probe is one task that reads one column
    probe = spark.read.format("jdbc").options(**options).load().select(quoted(split_by))
    predicates = equal_depth_predicates(probe, split_by, parts, mark or '"')
    url, table = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


def read_jdbc(spark: SparkSession, url: str, split_by: str | None = None, parts: int | None = None, **kwargs) -> DataFrame:
    return _load(spark, jdbc_options(url, **kwargs), split_by, parts, kwargs.get("quote", '"'))


def mysql_options(host: str, database: str, username: str, password: str, table=None, query=None, port=MYSQL_PORT, **kw):
    # without a cursor the MySQL driver holds a whole result set in memory
    settings = {"quote": "`", "driver": "com.mysql.cj.jdbc.Driver", "useCursorFetch": "true", "fetchsize": "10000", **kw}
    return jdbc_options(f"jdbc:mysql://{host}:{port}/{database}", username, password, table, query, **settings)


def postgresql_options(
    host: str, database: str, username: str, password: str, table=None, query=None, port=POSTGRESQL_PORT, **kw
):
    settings = {"driver": "org.postgresql.Driver", "fetchsize": "10000", **kw}
    return jdbc_options(f"jdbc:postgresql://{host}:{port}/{database}", username, password, table, query, **settings)


def bigquery_options(project_id: str, query=None, table_id=None, credentials_path=None, **kw) -> dict[str, str]:
    out = {"parentProject": project_id, **{k: str(v) for k, v in kw.items()}}
    if query:
        out["query"] = query
        out.setdefault("viewsEnabled", "true")
    elif table_id:
        out["table"] = table_id
    else:
        raise ValueError("either 'query' or 'table_id' must be given")
    if credentials_path:
        out["credentialsFile"] = credentials_path
    return out


def read_mysql(
    spark: SparkSession, host, database, username, password, table=None, query=None, port=MYSQL_PORT,
    split_by: str | None = None, parts: int | None = None, **kw,
):
    return _load(spark, mysql_options(host, database, username, password, table, query, port, **kw), split_by, parts, "`")


def read_postgresql(
    spark: SparkSession, host, database, username, password, table=None, query=None, port=POSTGRESQL_PORT,
    split_by: str | None = None, parts: int | None = None, **kw,
):
    return _load(spark, postgresql_options(host, database, username, password, table, query, port, **kw), split_by, parts, '"')


def read_bigquery(spark: SparkSession, project_id, query=None, table_id=None, credentials_path=None, **kw) -> DataFrame:
    return spark.read.format("bigquery").options(**bigquery_options(project_id, query, table_id, credentials_path, **kw)).load()
