"""SQLite files as a Spark data source, in both directions.

A "database" is one file, or a folder with a subfolder of files (shards) per
table.  Files must lie on a path that every executor can open.  Large files
are read as several row-id ranges; the writer makes one shard per task.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

# tasks get these classes by value, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "sqlite_files"
SUFFIXES = (".db", ".sqlite", ".sqlite3")
_RANGE_BYTES = 64 << 20  # file bytes per row-id range
_BATCH = 10_000


def local_path(path: str) -> str:
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            return path[len(scheme) :]
    if "://" in path:
        raise ValueError(f"SQLite files need a path that executors can open as files: {path}")
    return path


def _files(folder: str) -> list[str]:
    return sorted(p for x in SUFFIXES for p in glob.glob(os.path.join(glob.escape(folder), f"*{x}")))


def shards(path: str, table: str) -> list[str]:
    """The files that hold a table."""
    path = local_path(path)
    if os.path.isdir(path):
        folder = os.path.join(path, table)
        found = _files(folder if os.path.isdir(folder) else path)
    else:
        found = [path] if os.path.exists(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(f"no SQLite file of table {table!r} at {path}")
    return found


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _tables_of(file: str) -> list[str]:
    conn = connect(file)
    try:
        rows = conn.execute(
            "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite!_%' ESCAPE '!'"
        )
        return [r[0] for r in rows]
    finally:
        conn.close()


def list_tables(path: str) -> list[str]:
    """Table names; in one file they come in order of creation."""
    path = local_path(path)
    if os.path.isdir(path):
        folders = sorted(e.path for e in os.scandir(path) if e.is_dir())
        first = [f[0] for f in (_files(path), *map(_files, folders)) if f]
    else:
        first = ([path] if os.path.exists(path) else sorted(glob.glob(path)))[:1]
        if not first:
            raise FileNotFoundError(f"no SQLite file at {path}")
    out: list[str] = []
    for file in first:
        out += [t for t in _tables_of(file) if t not in out]
    return out


def declared_columns(path: str, table: str) -> list[tuple[str, str]]:
    """``(column, declared type)`` of a table or view."""
    conn = connect(shards(path, table)[0])
    try:
        rows = conn.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    finally:
        conn.close()
    if not rows:
        raise ValueError(f"no table named {table!r} in {path}")
    return [(r[1], r[2] or "") for r in rows]


def spark_type(declared: str) -> T.DataType:
    """Spark type by the affinity rules of the file format; dates are stored as text."""
    d = declared.upper()
    if "INT" in d or "BOOL" in d:
        return T.LongType()
    if any(k in d for k in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(k in d for k in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.StringType()


def sqlite_type(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "REAL"
    if isinstance(dtype, T.BinaryType):
        return "BLOB"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.DateType):
        return "DATE"
    return "TEXT"


def _converter(dtype: T.DataType, name: str):
    """Stored value to the column's type; a value of another kind raises."""

    def whole(v):
        if isinstance(v, float) and not v.is_integer() or isinstance(v, (str, bytes)):
            raise ValueError(f"column {name!r} holds {v!r}; read it with schema='{name} string'")
        return int(v)

    def real(v):
        if isinstance(v, (str, bytes)):
            raise ValueError(f"column {name!r} holds {v!r}; read it with schema='{name} string'")
        return float(v)

    if isinstance(dtype, T.BooleanType):
        return bool
    if isinstance(dtype, T.IntegralType):
        return whole
    if isinstance(dtype, T.FractionalType):
        return real
    if isinstance(dtype, T.BinaryType):
        return lambda v: v if isinstance(v, bytes) else str(v).encode()
    return lambda v: v if isinstance(v, str) else v.decode() if isinstance(v, bytes) else str(v)


@dataclass
class _Range(InputPartition):
    path: str
    low: int | None = None
    high: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.path = options["path"]
        self.table = options["table"]

    def partitions(self):
        out = []
        for path in shards(self.path, self.table):
            pieces = max(1, os.path.getsize(path) // _RANGE_BYTES)
            bounds = None
            if pieces > 1:
                conn = connect(path)
                try:
                    bounds = conn.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:
                    bounds = None  # a view, or a table without row ids
                finally:
                    conn.close()
            if not bounds or bounds[0] is None:
                out.append(_Range(path))
                continue
            low, high = bounds
            step = (high - low) // pieces + 1
            out += [_Range(path, s, min(s + step - 1, high)) for s in range(low, high + 1, step)]
        return out

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        names = [f.name for f in self.schema.fields]
        convert = [_converter(f.dataType, f.name) for f in self.schema.fields]
        query, params = f"SELECT {', '.join(quoted(n) for n in names)} FROM {quoted(self.table)}", []
        if partition.low is not None:
            query += " WHERE rowid BETWEEN ? AND ?"
            params = [partition.low, partition.high]
        arrow = to_arrow_schema(self.schema)
        conn = connect(partition.path)
        try:
            cursor = conn.execute(query, params)
            while rows := cursor.fetchmany(_BATCH):
                columns = [
                    pa.array([None if v is None else c(v) for v in values], type=field.type)
                    for values, c, field in zip(zip(*rows), convert, arrow)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            conn.close()


@dataclass
class _Shard(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema = schema
        self.table = options["table"]
        self.folder = os.path.join(local_path(options["path"]), self.table)
        self.overwrite = overwrite

    def write(self, iterator) -> _Shard:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"_staged-{uuid.uuid4().hex}")
        columns = ", ".join(f"{quoted(f.name)} {sqlite_type(f.dataType)}" for f in self.schema.fields)
        marks = ", ".join("?" for _ in self.schema.fields)
        plain = (int, float, str, bytes, type(None))

        def stored(v):
            return v if isinstance(v, plain) else str(v)

        rows, batch = 0, []
        conn = sqlite3.connect(path)
        try:
            conn.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
            insert = f"INSERT INTO {quoted(self.table)} VALUES ({marks})"
            for row in iterator:
                batch.append(tuple(stored(v) for v in row))
                if len(batch) == _BATCH:
                    conn.executemany(insert, batch)
                    rows += len(batch)
                    batch = []
            conn.executemany(insert, batch)
            conn.commit()
        finally:
            conn.close()
        return _Shard(path, rows + len(batch))

    def commit(self, messages) -> None:
        earlier = _files(self.folder) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.path, os.path.join(self.folder, f"part-{uuid.uuid4().hex}.db"))
        for path in earlier:
            os.remove(path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class SQLiteFiles(DataSource):
    """``spark.read.format("sqlite_files").option("table", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        columns = declared_columns(self.options["path"], self.options["table"])
        return T.StructType([T.StructField(n, spark_type(d)) for n, d in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(SQLiteFiles)


def read_sqlite_table(spark, path: str, table: str, schema=None):
    """A whole table of a database; ``schema`` overrides the declared types."""
    register(spark)
    reader = spark.read.format(FORMAT).option("table", table)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(local_path(path))


def read_sqlite_query(spark, path: str, query: str):
    """A query over the tables of a database, planned and run by Spark."""
    from tableassay.plans.sql import run_sql

    return run_sql(spark, query, {t: read_sqlite_table(spark, path, t) for t in list_tables(path)})


def write_sqlite(df, path: str, table: str, mode: str = "overwrite") -> None:
    """Write a table into a database folder, one file per task."""
    register(df.sparkSession)
    df.write.format(FORMAT).option("table", table).mode(mode).save(local_path(path))
