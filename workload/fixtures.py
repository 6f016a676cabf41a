"""Files written from the given tables, for the reader queries."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableassay.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def workbook_bytes(rows: pd.DataFrame, sheet: str = "data") -> bytes:
    """A small .xlsx file: numbers as numbers, text inline, missing cells left out."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    lines = [f"<row>{''.join(cell(str(c)) for c in rows.columns)}</row>"]
    columns = [rows[c].tolist() for c in rows.columns]
    lines += [f"<row>{''.join(cell(v) for v in values)}</row>" for values in zip(*columns)]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types">'
        '<Default Extension="xml" ContentType="application/xml"/></Types>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}">'
        f'<sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">'
        f'<Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in parts.items():
            book.writestr(name, content)
    return out.getvalue()


def write_workbooks(df: DataFrame, files: int = 4) -> str:
    """The table as a folder of workbooks, one per task."""
    from tableassay.sources.sqlite import local_path

    folder = local_path(scratch_path(df.sparkSession, "workbooks"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        parts = list(batches)
        rows = sum(len(p) for p in parts)
        if rows:
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/part-{uuid.uuid4().hex}.xlsx", "wb") as f:
                f.write(workbook_bytes(pd.concat(parts)))
        yield pd.DataFrame({"rows": [rows]})

    df.repartition(files).mapInPandas(write, "rows long").write.format("noop").mode("overwrite").save()
    return folder


def write_csv(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return path


def write_json(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "json")
    df.write.json(path)
    return path


def write_csv_texts(df: DataFrame) -> str:
    """Quoted cells with their line breaks; two folders' files with other orders of columns."""
    path = scratch_path(df.sparkSession, "csv-texts")
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for i, columns in enumerate((df.columns, df.columns[::-1])):
        part = df.where(f"{df.columns[0]} % 2 = {i}").select(columns)
        part.write.mode("append").options(header=True, quoteAll=True, escape='"', **spaces).csv(path)
    return path


def write_json_forms(df: DataFrame, key: str) -> list[str]:
    """A third of the rows as lines, a third as arrays, a third as objects of columns."""
    paths = [scratch_path(df.sparkSession, f"json-{form}") for form in ("lines", "arrays", "columns")]
    part = [df.where(f"{key} % 3 = {i}").withColumn("_file", F.col(key) % 7) for i in range(3)]
    part[0].drop("_file").write.json(paths[0])
    record = F.to_json(F.struct(*df.columns))
    arrays = part[1].groupBy("_file").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    label = F.col(key).cast("string")
    columns = [F.concat(F.lit(f'"{c}":'), F.to_json(F.map_from_entries(F.collect_list(F.struct(label, c))))) for c in df.columns]
    turned = part[2].groupBy("_file").agg(F.concat(F.lit("{"), F.concat_ws(",", *columns), F.lit("}")).alias("value"))
    for texts, path in zip((arrays, turned), paths[1:]):
        texts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return paths


def small_splits(spark: SparkSession, size: str = "64k") -> SparkSession:
    """A session whose scans cut even small files."""
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", size)
    other.conf.set("spark.sql.files.openCostInBytes", "1k")
    return other
