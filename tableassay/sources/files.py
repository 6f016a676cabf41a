"""CSV, JSON and Parquet readers."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableassay.functions.schema import quoted, text, union_all
from tableassay.functions.values import is_number_text
from tableassay.session import scratch_path
from tableassay.sources import records

# Texts that a CSV or workbook reader takes for a missing cell.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Texts that stand for a boolean.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")


def _in(sql: str, values: Iterable[str]) -> str:
    return f"{sql} IN ({', '.join(text(v) for v in values)})"


def null_tokens(na_values: Iterable[str] | str | None = None, keep_default_na: bool = True) -> tuple[str, ...]:
    extra = (na_values,) if isinstance(na_values, str) else tuple(na_values or ())
    return (NULL_TOKENS if keep_default_na else ()) + extra


def without_tokens(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """Text columns with the null tokens read as missing."""
    tokens = tuple(tokens)
    if not tokens:
        return df
    return df.selectExpr(
        *[
            f"IF({_in(quoted(f.name), tokens)}, NULL, {quoted(f.name)}) AS {quoted(f.name)}"
            if isinstance(f.dataType, T.StringType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def infer_types(raw: DataFrame, infer_dates: bool = False) -> dict[str, str]:
    """The narrowest type that holds every value of each text column.

    One scan that returns one row of flags, as schema inference does.
    """
    tests = {
        "bigint": lambda c: f"({c} RLIKE r'^\\s*[+-]?\\d+\\s*$' AND try_cast(trim({c}) AS BIGINT) IS NOT NULL)",
        "double": is_number_text,
        "boolean": lambda c: _in(c, TRUE_TEXTS + FALSE_TEXTS),
    }
    if infer_dates:
        tests["timestamp_ntz"] = lambda c: f"(try_cast({c} AS TIMESTAMP_NTZ) IS NOT NULL)"
    flags = [
        f"coalesce(bool_and(IF({quoted(n)} IS NULL, NULL, {test(quoted(n))})), false)"
        for n in raw.columns
        for test in tests.values()
    ]
    row = raw.selectExpr(*[f"{f} AS f{i}" for i, f in enumerate(flags)]).first()
    out = {}
    for i, n in enumerate(raw.columns):
        hits = row[i * len(tests) : (i + 1) * len(tests)]
        out[n] = next((t for t, hit in zip(tests, hits) if hit), "string")
    return out


def cast_texts(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast to their types; a value that does not fit raises."""

    def cast(name: str) -> str:
        c, dtype = quoted(name), types.get(name, "string")
        if dtype == "string":
            return c
        if dtype == "boolean":
            return f"CAST({c} AS BOOLEAN) AS {c}"
        return f"CAST(trim({c}) AS {dtype}) AS {c}"

    return raw.selectExpr(*[cast(n) for n in raw.columns])


#: Options that leave the layout of a file to Spark's own reader.
_SPARK_LAYOUT = ("multiLine", "comment", "encoding", "charset", "lineSep")
_CORRUPT = "_not_a_row"


def _cells(record: str, sep: str, quote: str) -> list[str]:
    return next(csv.reader([record], delimiter=sep, quotechar=quote), [])


def _named(cells: list[str]) -> list[str]:
    """Column names from a head: empty ones by position, repeated ones numbered."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name, n = cell or f"_c{i}", 0
        while name in out:
            n += 1
            name = f"{cell or f'_c{i}'}.{n}"
        out.append(name)
    return out


def _whole_rows(rows: DataFrame, columns: list[str], sep: str, quote: str) -> DataFrame:
    """``rows`` without the parser's note of rows that have another number of cells: with
    fewer the last are missing, with more the job ends."""
    q, s = (re.escape(x) for x in (quote, sep))
    # no text of the first column: Spark refuses to read the note without any column beside it
    nothing = f"substring(coalesce({quoted(columns[0])}, ''), 1, 0)"
    bare = f"regexp_replace(concat({_CORRUPT}, {nothing}), {text(f'{q}[^{q}]*{q}')}, '')"
    cells = f"(regexp_count({bare}, {text(s)}) + 1)"
    said = f"concat('a row of ', {cells}, ' cells under {len(columns)} names: ', left({_CORRUPT}, 80))"
    fits = f"CASE WHEN concat({_CORRUPT}, {nothing}) IS NULL OR {cells} <= {len(columns)} THEN true ELSE raise_error({said}) END"
    return rows.where(fits).drop(_CORRUPT)


def _text_rows(spark: SparkSession, path: str | list[str], settings: dict, names: list[str] | None, wanted: list[str] | None) -> DataFrame:
    """All cells as text, files with other orders of columns merged by name."""
    sep, quote, header = settings["sep"], settings.get("quote", '"'), settings["header"]
    found = records.CsvLayout(records.lines(spark, path), sep, quote, settings["escape"])
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, head in found.heads.items():
        if head:
            cells = _cells(head, sep, quote)
            own = _named(cells) if header else names or wanted or [f"_c{i}" for i in range(len(cells))]
            groups.setdefault(tuple(own), []).append(file)
    if not groups:
        if wanted or names:
            return spark.createDataFrame([], ", ".join(f"{quoted(n)} string" for n in wanted or names))
        raise ValueError(f"no header and no rows in {path}")
    first = next(iter(groups))
    for other in groups:
        if header and set(other) != set(wanted or first):
            raise ValueError(f"the header {list(other)} of {groups[other][0]} has not the columns {list(wanted or first)}")
        if not header and len(other) != len(first):
            raise ValueError(f"{groups[other][0]} has {len(other)} columns, not {len(first)}")
    options = {**settings, "columnPruning": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    ddl = {columns: ", ".join(f"{quoted(n)} string" for n in [*columns, _CORRUPT]) for columns in groups}
    if found.spans_lines:
        # one scan for all orders of columns: a record is parsed in its file's order
        texts_only = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k not in ("header", "enforceSchema", "inferSchema", "columnPruning")}
        parsed = {columns: F.from_csv("record", ddl[columns], texts_only) for columns in groups}
        if len(groups) > 1:
            parsed = {columns: F.when(F.col("file").isin(groups[columns]), row) for columns, row in parsed.items()}
        rows = found.records(header).select(*[row.alias(f"row{i}") for i, row in enumerate(parsed.values())])
        cells = [F.coalesce(*[F.col(c)[n] for c in rows.columns]).alias(n) for n in [*first, _CORRUPT]]
        return _whole_rows(rows.select(*cells), list(first), sep, quote).selectExpr(*[quoted(n) for n in wanted or first])
    parts = []
    for columns, own in groups.items():
        rows = spark.read.options(**options).schema(ddl[columns]).csv(path)
        rows = rows if len(groups) == 1 else rows.where(F.col("_metadata.file_path").isin(own))
        parts.append(_whole_rows(rows, list(columns), sep, quote).selectExpr(*[quoted(n) for n in wanted or (first if header else columns)]))
    return union_all(parts)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType | None = None,
    *,
    sep: str = ",",
    header: bool = True,
    names: list[str] | None = None,
    usecols: list[str] | None = None,
    dtype: dict[str, str] | None = None,
    na_values: Iterable[str] | str | None = None,
    keep_default_na: bool = True,
    infer_dates: bool = False,
    scan: bool = True,
    **options,
) -> DataFrame:
    """CSV files with a header line and inferred types.

    Null tokens are removed before types are inferred, so a number column with
    ``NA`` cells stays a number column.  Dates stay text unless ``infer_dates``.

    One scan of the lines finds each file's header and whether quoted cells hold line
    breaks; if so, records are put together from lines, and files still split.  Files
    merge by column name, whatever their order, also with ``schema``; files with other
    names raise, and so do rows with more cells than names.  Rows with fewer cells lack
    the last ones.  ``scan=False`` leaves the layout to Spark's reader, for files known
    to be alike and without quoted breaks; headers that differ then raise.
    Pass ``schema`` in production jobs: it saves the inference scan.
    """
    settings = {"sep": sep, "header": header, "escape": '"', "inferSchema": False, "emptyValue": "", **options}
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not scan or any(k in options for k in _SPARK_LAYOUT):
        reader = spark.read.options(**({"enforceSchema": False} if header else {}), **settings)
        if typed is not None:
            reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in typed.fields]))
        raw = reader.csv(path)
    else:
        raw = _text_rows(spark, path, settings, None if header else names, typed.names if typed is not None else None)
    if typed is None and names:
        raw = raw.toDF(*names)
    if usecols:
        raw = raw.selectExpr(*[quoted(n) for n in usecols])
    raw = without_tokens(raw, null_tokens(na_values, keep_default_na))
    if typed is not None:
        kinds = {f.name: f.dataType.simpleString() for f in typed.fields}
        return cast_texts(raw, kinds)
    fixed = dict(dtype or {})
    open_ = [n for n in raw.columns if n not in fixed]
    if open_:
        fixed.update(infer_types(raw.selectExpr(*[quoted(n) for n in open_]), infer_dates))
    return cast_texts(raw, fixed)


def _turned(texts: DataFrame) -> DataFrame:
    """Records of files that hold one object each, ``(record)``.

    Where all values of the object are objects, it is read as pandas reads it: columns
    that map row labels to cells.  Rows come from the labels; a column without a label
    lacks that cell.  Otherwise the object is one record."""
    cells = texts.select("file", F.from_json("value", "map<string, variant>", {"mode": "FAILFAST"}).alias("columns"), "value")
    kinds = F.transform(F.map_values("columns"), lambda v: F.schema_of_variant(v))
    form = cells.withColumn("by_column", (F.size("columns") > 0) & F.forall(kinds, lambda k: k.startswith("OBJECT")))
    whole = form.where("NOT by_column").select(F.translate("value", "\n\r", "  ").alias("record"))
    parts = form.where("by_column").select("file", F.explode(F.from_json("value", "map<string, map<string, variant>>", {"mode": "FAILFAST"})).alias("column", "cells"))
    parts = parts.select("file", "column", F.explode("cells").alias("label", "cell"))
    # a name as JSON text: the object of that one name without its brackets and value
    pair = F.concat(F.expr("substring(to_json(map(column, 0)), 2, length(to_json(map(column, 0))) - 3)"), F.coalesce(F.to_json("cell"), F.lit("null")))
    rows = parts.groupBy("file", "label").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("record"))
    return whole.unionByName(rows.select("record"))


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType | None = None,
    *,
    lines: bool | None = None,
    **options,
) -> DataFrame:
    """JSON files: objects one per line, an array of objects, one object, or one object of
    columns (``{"a": {"0": 1}}``), as pandas writes tables.

    Each file has the form that a scan of its brackets finds, so a folder may mix them.
    ``lines=True`` says that all have an object per line and saves the scan.  Arrays are cut
    between their elements, at line ends too, so a large file of many lines is read by many
    tasks; their elements are written once as lines to the shared folder.  Malformed input,
    text after an array and elements that are not objects raise.
    """
    settings = {"mode": "FAILFAST", **options}
    if lines:
        parts = [path] if isinstance(path, str) else list(path)
    else:
        found = records.JsonLayout(records.lines(spark, path))
        parts, made = [unquote(f) for f in found.files("lines")], []
        if found.files("array"):
            made.append(found.elements().select("record"))
        if found.files("one"):
            whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
            made.append(_turned(whole.where(F.col("file").isin(found.files("one")))))
        if made:
            staged = scratch_path(spark, "json-lines")
            union_all(made).write.text(staged)
            parts = [*parts, staged]
        elif not found.files("array", "empty"):
            parts = [path] if isinstance(path, str) else list(path)
        if not parts:
            return spark.createDataFrame([], schema if schema is not None else T.StructType())
    reader = spark.read.options(**settings)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(parts)


def read_parquet(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.options(**options).parquet(*paths)
