"""Workbook (.xlsx) ingest: many files, parsed by the tasks that read them.

A workbook is a zip of XML parts.  Each task takes whole files (a sheet holds
at most 1,048,576 rows by format) and yields rows in batches; types are then
settled by one aggregate over all files.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# tasks get these functions by value, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = "path string, row int, cells array<string>, kinds array<string>"
_BATCH = 5000

# Fixed values of the file format: number formats that show dates or times.
_DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _date_styles(book) -> set[int]:
    """Positions of cell styles that show a date."""
    import re
    from xml.etree import ElementTree

    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {}
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        custom[int(f.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code, re.I))
    styles = root.find(f"{_MAIN}cellXfs")
    out = set()
    for i, xf in enumerate(styles if styles is not None else ()):
        fmt = int(xf.get("numFmtId", 0))
        if fmt in _DATE_FORMATS or custom.get(fmt, False):
            out.add(i)
    return out


def _sheet_part(book, sheet: str | int | None) -> str:
    """Zip entry of a sheet by name or position; the first by default."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [(s.get("name"), s.get(_REL)) for s in root.iter(f"{_MAIN}sheet")]
    by_name = dict(sheets)
    if isinstance(sheet, str):
        if sheet not in by_name:
            raise ValueError(f"no sheet named {sheet!r}")
        rel = by_name[sheet]
    else:
        rel = sheets[sheet or 0][1]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == rel)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(ref: str) -> int:
    at = 0
    for ch in ref:
        if not ch.isalpha():
            break
        at = at * 26 + ord(ch.upper()) - 64
    return at - 1


def sheet_rows(content: bytes, sheet: str | int | None = None) -> Iterator[tuple[int, list, list]]:
    """``(row, cells, kinds)``; kinds are n(umber), s(tring), b(oolean), d(ate) or None."""
    import io
    import zipfile
    from datetime import datetime, timedelta
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            for item in root.iter(f"{_MAIN}si"):
                runs = [item] + item.findall(f"{_MAIN}r")
                shared.append("".join(t.text or "" for r in runs for t in r.findall(f"{_MAIN}t")))
        dates = _date_styles(book)
        setup = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
        late = setup is not None and setup.get("date1904") in ("1", "true")
        origin = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)

        def read(cell):
            kind, style = cell.get("t", "n"), int(cell.get("s", 0))
            if kind == "inlineStr":
                return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")), "s"
            value = cell.findtext(f"{_MAIN}v")
            if value is None or kind == "e":
                return None, None
            if kind == "s":
                return shared[int(value)], "s"
            if kind == "b":
                return ("true" if value == "1" else "false"), "b"
            if kind == "d":
                return value, "d"
            if kind == "str":
                return value, "s"
            if style in dates:
                moment = origin + timedelta(days=float(value))
                moment = (moment + timedelta(microseconds=500)).replace(microsecond=0)
                return moment.isoformat(sep=" "), "d"
            return value, "n"

        with book.open(_sheet_part(book, sheet)) as part:
            number = 0
            for _, element in ElementTree.iterparse(part):
                if element.tag != f"{_MAIN}row":
                    continue
                number = int(element.get("r", number + 1))
                cells, kinds = [], []
                for i, cell in enumerate(element.findall(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    while len(cells) < at:
                        cells.append(None)
                        kinds.append(None)
                    value, kind = read(cell)
                    cells.append(value)
                    kinds.append(kind)
                element.clear()
                if any(k is not None for k in kinds):
                    yield number, cells, kinds


def _parser(sheet: str | int | None):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                rows = []
                for row, cells, kinds in sheet_rows(content, sheet):
                    rows.append((path, row, cells, kinds))
                    if len(rows) == _BATCH:
                        yield pd.DataFrame(rows, columns=["path", "row", "cells", "kinds"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "row", "cells", "kinds"])

    return parse


def _rows(files: DataFrame, sheet: str | int | None) -> DataFrame:
    return files.select("path", "content").mapInPandas(_parser(sheet), _ROWS)


def _types(body: DataFrame, width: int) -> list[str]:
    """The type that holds every cell of each position: one scan, one row back."""
    flags = []
    for i in range(width):
        kind, cell = f"get(kinds, {i})", f"get(cells, {i})"
        flags += [
            f"coalesce(bool_and(IF({kind} IS NULL, NULL, {kind} = '{k}')), false) AS {k}{i}" for k in ("n", "b", "d")
        ]
        flags.append(f"coalesce(bool_and({cell} RLIKE '^-?[0-9]+$'), false) AS i{i}")
    row = body.selectExpr(*flags).first().asDict()
    out = []
    for i in range(width):
        if row[f"n{i}"]:
            out.append("bigint" if row[f"i{i}"] else "double")
        else:
            out.append("boolean" if row[f"b{i}"] else "timestamp_ntz" if row[f"d{i}"] else "string")
    return out


def read_excel(
    spark: SparkSession,
    path: str | list[str],
    sheet_name: str | int | None = None,
    schema: str | T.StructType | None = None,
    *,
    usecols: list[str] | None = None,
    na_values=None,
    keep_default_na: bool = True,
) -> DataFrame:
    """One sheet of every workbook under ``path`` as one table; the first sheet by default.

    The first row of each sheet names the columns; all workbooks must share
    the layout of the first one.  With ``schema`` no inference scan runs.
    """
    from tableassay.functions.schema import quoted
    from tableassay.sources.files import null_tokens, without_tokens

    if any(p.lower().endswith(".xls") for p in ([path] if isinstance(path, str) else path)):
        raise ValueError("old binary .xls workbooks are not supported; save as .xlsx")
    files = spark.read.format("binaryFile").load(path)
    if schema is None:
        first = files.selectExpr("min(path) AS path").first()["path"]
        if first is None:
            raise ValueError(f"no workbook found at {path}")
        head = _rows(spark.read.format("binaryFile").load(first), sheet_name).orderBy("row").first()
        names = [c if c is not None else f"Unnamed: {i}" for i, c in enumerate(head["cells"])] if head else []
        if not names:
            raise ValueError(f"the sheet of {first} is empty")
    else:
        typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = [f.name for f in typed.fields]
    body = _rows(files, sheet_name).where("row > 1")
    if schema is None:
        types = _types(body, len(names))
    else:
        types = [f.dataType.simpleString() for f in typed.fields]
    cells = []
    for i, (n, t) in enumerate(zip(names, types)):
        if usecols is None or n in usecols:
            # whole numbers may be stored as 5.0 or 1E3
            value = f"CAST(get(cells, {i}) AS DOUBLE)" if t == "bigint" else f"get(cells, {i})"
            cells.append(f"CAST({value} AS {t}) AS {quoted(n)}" if schema else f"CAST(get(cells, {i}) AS {t}) AS {quoted(n)}")
    return without_tokens(body.selectExpr(*cells), null_tokens(na_values, keep_default_na))
