"""Writers: tables with a dense row key, and report folders."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableassay.functions.schema import quoted
from tableassay.session import scratch_path
from tableassay.sources import sqlite

_POSITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def add_row_key(
    df: DataFrame, order_by: str | list[str], name: str = "index", partitions: int | None = None
) -> DataFrame:
    """The table with a dense 0-based row number in the order of the key, first.

    Rows are range-partitioned and numbered within each partition; offsets come
    from one count per partition.  The ordered rows are staged as a table in
    the shared folder first: both steps must see the same partitions, also
    after a lost executor.  Ties in the key are spread by row hash and a random
    number, so equal keys cannot gather in one partition.  ``partitions`` is
    their number, by default that of shuffles.
    """
    return _keyed(df, order_by, name, partitions)[0]


def _keyed(
    df: DataFrame, order_by: str | list[str], name: str, partitions: int | None = None
) -> tuple[DataFrame, str]:
    """The table with its row number, and the folder of the staged rows that it reads."""
    spark = df.sparkSession
    keys = [F.col(quoted(c)) for c in ([order_by] if isinstance(order_by, str) else order_by)]
    hashable = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    ties = df.withColumns(
        {"_hash": F.expr(f"xxhash64({', '.join(hashable)})"), "_tie": F.rand(0)}
    )
    order = [*keys, F.col("_hash"), F.col("_tie")]
    numbered = (
        ties.repartitionByRange(*([partitions] if partitions else []), *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(_POSITION)})
        .drop("_hash", "_tie")
    )
    staged = scratch_path(spark, "row-key")
    numbered.write.parquet(staged)
    rows = spark.read.parquet(staged)
    # one row per partition of the staged table
    offsets = rows.groupBy("_part").agg(F.expr("count(1) AS n")).selectExpr(
        "_part", "sum(n) OVER (ORDER BY _part) - n AS _before"
    )
    return rows.join(F.broadcast(offsets), "_part").selectExpr(
        f"_before + _pos AS {quoted(name)}", *[quoted(c) for c in df.columns]
    ), staged


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _remove(spark: SparkSession, path: str) -> None:
    fs, make = _file_system(spark, path)
    fs.delete(make(path), True)


def _swap_folder(df: DataFrame, target: str, format: str, options: dict) -> None:
    """Write a hidden folder beside the target, then rename it into place."""
    spark = df.sparkSession
    fs, make = _file_system(spark, target)
    place = make(target)
    tag = uuid.uuid4().hex[:12]
    new, old = (make(place.getParent(), f".{place.getName()}-{kind}-{tag}") for kind in ("new", "old"))
    moved = False
    try:
        df.write.format(format).options(**options).save(new.toString())
        if fs.exists(place):
            moved = fs.rename(place, old)
            if not moved:
                raise OSError(f"{target} cannot be moved aside")
        if not fs.rename(new, place):
            raise OSError(f"{new.toString()} cannot be moved to {target}")
    except BaseException:
        if moved and not fs.exists(place):
            fs.rename(old, place)
        fs.delete(new, True)
        raise
    fs.delete(old, True)
    spark.catalog.refreshByPath(target)


def _swap_table(df: DataFrame, target: str, options: dict) -> None:
    """Save a table beside the target, then rename it into place."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(target):
        df.write.options(**options).saveAsTable(target)
        return
    tag = uuid.uuid4().hex[:12]
    # the tag goes into the last part of a qualified name, quoted or not
    new, old = (f"{target[:-1]}_{kind}_{tag}`" if target.endswith("`") else f"{target}_{kind}_{tag}" for kind in ("new", "old"))
    try:
        df.write.options(**options).saveAsTable(new)
        spark.sql(f"ALTER TABLE {target} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {new} RENAME TO {target}")
    except BaseException:
        if spark.catalog.tableExists(old) and not spark.catalog.tableExists(target):
            spark.sql(f"ALTER TABLE {old} RENAME TO {target}")
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    spark.sql(f"DROP TABLE {old}")


def write_table(
    df: DataFrame,
    target: str,
    order_by: str | list[str] | None = None,
    index_label: str | None = None,
    format: str = "parquet",
    table: str | None = None,
    **options,
) -> None:
    """Replace a table; with ``index_label`` a dense row key comes first.

    ``format`` is a file format (``target`` is a path), ``table`` (a name in
    the session catalog), ``sqlite`` (a database folder) or ``jdbc`` (a URL);
    the last two take the table name as ``table``.

    Files and catalog tables are written beside the old ones and renamed into
    place when all rows are written.  So a table can be replaced by a result
    that reads it, and a write that fails leaves the old one.  Between two
    renames a reader may find no table; on object stores a rename copies.  The
    staged rows of the row key are removed.
    """
    spark, staged = df.sparkSession, None
    if index_label is not None:
        if order_by is None:
            raise ValueError("a row key needs order_by")
        df, staged = _keyed(df, order_by, index_label)
    try:
        if format == "table":
            _swap_table(df, target, options)
        elif format == "sqlite":
            sqlite.write_sqlite(df, target, table or "data")
        elif format == "jdbc":
            df.write.mode("overwrite").format("jdbc").options(url=target, dbtable=table, **options).save()
        else:
            _swap_folder(df, target, format, options)
    finally:
        if staged:
            _remove(spark, staged)


def write_report(tables: Mapping[str, DataFrame], folder: str, format: str = "parquet") -> list[str]:
    """Write each section of a report to its own subfolder; returns the paths."""
    paths = []
    for section, df in tables.items():
        path = f"{folder.rstrip('/')}/{section}"
        df.write.mode("overwrite").format(format).save(path)
        paths.append(path)
    return paths
