"""Choose the reader by file suffix."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from tableassay.sources import files, sqlite, workbook

_READERS = {
    ".csv": files.read_csv,
    ".xlsx": workbook.read_excel,
    ".json": files.read_json,
    ".parquet": files.read_parquet,
}


def load_auto(
    spark: SparkSession, path: str, table_name: str | None = None, query: str | None = None, **options
) -> DataFrame:
    """Read a file by its suffix, upper or lower case.

    ``table_name`` and ``query`` belong to SQLite files; a query wins over a
    table name, and without either the first table is read.
    """
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in sqlite.SUFFIXES:
        if query:
            return sqlite.read_sqlite_query(spark, path, query)
        if not table_name:
            tables = sqlite.list_tables(path)
            if not tables:
                raise ValueError(f"no tables found in {path}")
            table_name = tables[0]
        return sqlite.read_sqlite_table(spark, path, table_name, **options)
    if suffix not in _READERS:
        raise ValueError(f"unsupported file format: {suffix!r}")
    if table_name or query:
        raise ValueError(f"'table_name' and 'query' do not apply to {suffix} files")
    return _READERS[suffix](spark, path, **options)
