"""Records that run over several lines, found where the lines lie.

Spark splits text files at line ends, wherever the bytes of a split begin. Whether a
line end also ends a record depends on what stands before: an open quote in CSV, open
brackets in JSON. One scan notes per split what it does to that state, a few bytes each;
run in order of the splits they tell the state each split begins with. A second scan then
cuts every split into records, and only the pieces at its two ends travel, to be put
together.

The states belong to the splits of the first scan: a second scan that is split otherwise
raises (Spark sizes splits by its cores, unless ``spark.sql.files.minPartitionNum`` is set).
Small splits are read several to a task, one after another: a split costs a note, not a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPLIT = "file string, block bigint"
#: Bytes of splits that a task reads, at least, once every core has a few tasks.
TASK = 16 << 20


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, file, block)``: the lines, each with the split it is read in."""
    text = spark.read.option("lineSep", "\n").text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    splits, size = text.rdd.getNumPartitions(), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-splits * size // TASK))
    return text.coalesce(tasks) if tasks < splits else text


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """File and block of rows that follow each other, and their lines."""
    for batch in batches:
        value, file, block = batch.columns
        if not len(value):
            continue
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        ends = np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1
        for a, b in pairwise([0, *ends.tolist(), len(value)]):
            yield (file[a].as_py(), block[a].as_py()), value[a:b].to_pylist()


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """The lines of each split, in order; a task may read several."""
    for (file, block), parts in groupby(_runs(batches), key=lambda run: run[0]):
        yield file, block, (line for _, own in parts for line in own)


def _of(df: DataFrame, files: list[str]) -> DataFrame:
    """Lines of some files. The condition names the line, too: one on the file alone would
    keep other files from being listed, and with them change how Spark sizes splits."""
    return df.where(F.when(F.col("file").isin(files), F.lit(True)).otherwise(F.col("value").isNull()))


def layout(df: DataFrame, note: Callable[[int, Iterator[str]], dict], fields: str) -> list[dict]:
    """What ``note`` says of each split, by file and block. One row per split comes back."""

    schema = T.StructType.fromDDL(f"{SPLIT}, {fields}")
    typed = to_arrow_schema(schema)

    def run(batches):
        for file, block, own in _by_split(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, **note(block, own)}], typed)

    return sorted((r.asDict() for r in df.mapInArrow(run, schema).collect()), key=lambda r: (r["file"], r["block"]))


def cut(df: DataFrame, starts: dict[tuple[str, int], object], reader: Callable, glue: str, inside: int = 1) -> DataFrame:
    """``(file, record)``. ``reader(state, block, lines)`` yields ``(kind, text)``: ``whole``
    records, and at the ends of a split a ``head`` that ends a record of the split before, a
    ``tail`` that begins one, or one ``through`` piece that does neither.  A state of
    ``inside`` or more is inside a record."""
    spark = df.sparkSession
    known = spark.sparkContext.broadcast(starts)  # one entry per split

    def pieces(wanted: bool):
        def run(batches):
            for file, block, own in _by_split(batches):
                if (file, block) not in known.value:
                    raise ValueError(f"{file} was split otherwise in the scan before; read it again")
                held = []
                for kind, text in reader(known.value[file, block], block, own):
                    if (kind == "whole") == wanted:
                        held.append((kind, text))
                    if len(held) == 1000:
                        yield _pieces(file, block, held)
                        held = []
                if held:
                    yield _pieces(file, block, held)

        return run

    schema = f"{SPLIT}, kind string, record string"
    whole = df.mapInArrow(pieces(True), schema).select("file", "record")
    crossed = sorted({file for (file, block), state in starts.items() if block and state >= inside})
    if not crossed:
        return whole
    ends = _of(df, crossed).mapInArrow(pieces(False), schema)
    # a file has two pieces per split at most; a record's pieces run from its tail on
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail")
    ends = ends.withColumn("nth", F.count_if(F.col("kind") == "tail").over(order)).groupBy("file", "nth")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), glue)
    return whole.unionByName(ends.agg(joined.alias("record")).select("file", "record"))


def _pieces(file: str, block: int, held: list[tuple[str, str]]) -> pa.RecordBatch:
    kinds, texts = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([block] * len(held), pa.int64()), pa.array(kinds), pa.array(texts, pa.string())], ["file", "block", "kind", "record"])


# CSV -------------------------------------------------------------------------


def inside_after(line: str, inside: bool, sep: str, quote: str, escape: str) -> bool:
    """Whether a quoted cell is open after the line; a quote opens only where a cell begins."""
    at = 0
    if not inside and line.startswith(quote):
        inside, at = True, len(quote)
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if escape == quote and line.startswith(quote, at + 1):
                at += 2
                continue
            if escape != quote:
                back = at
                while back and line[back - 1] == escape:
                    back -= 1
                if (at - back) % 2:
                    at += 1
                    continue
            inside, at = False, at + 1
        else:
            at = line.find(sep + quote, at)
            if at < 0:
                return False
            inside, at = True, at + len(sep) + len(quote)


class CsvLayout:
    """Heads of the files and the state each split begins with."""

    def __init__(self, df: DataFrame, sep: str, quote: str, escape: str):
        def note(block, own):
            head, ends, spans = None, [False, True], False
            for line in own:
                head = line if head is None and block == 0 else head
                if quote in line:
                    spans |= inside_after(line, False, sep, quote, escape)
                    ends = [inside_after(line, s, sep, quote, escape) for s in ends]
            return {"head": head, "closed": ends[0], "open": ends[1], "spans": spans}

        self.df, self.rule = df, (sep, quote, escape)
        self.splits = layout(df, note, "head string, closed boolean, open boolean, spans boolean")
        self.starts, inside, last = {}, False, None
        for s in self.splits:
            if s["file"] != last:
                self._closed(last, inside)
                inside, last = False, s["file"]
            self.starts[s["file"], s["block"]] = inside
            inside = s["open"] if inside else s["closed"]
        self._closed(last, inside)

    @staticmethod
    def _closed(file: str | None, inside: bool) -> None:
        if inside:
            raise ValueError(f"a quoted cell of {file} is not closed")

    @property
    def heads(self) -> dict[str, str]:
        return {s["file"]: (s["head"] or "").removesuffix("\r") for s in self.splits if s["block"] == 0}

    @property
    def spans_lines(self) -> bool:
        return any(s["spans"] for s in self.splits)

    def records(self, header: bool) -> DataFrame:
        """``(file, record)`` without heads and blank lines."""
        rule = self.rule

        def reader(inside, block, own):
            held, kind = [], "head" if inside else "whole"
            if header and block == 0:
                next(own, None)
            for line in own:
                held.append(line)
                if rule[1] in line or inside:
                    inside = inside_after(line, inside, *rule)
                if not inside:
                    record = "\n".join(held).removesuffix("\r")
                    if record:
                        yield kind, record
                    held, kind = [], "whole"
            if held:
                yield ("through" if kind == "head" else "tail"), "\n".join(held)

        out = cut(self.df, self.starts, reader, "\n")
        return out.withColumn("record", F.regexp_replace("record", "\r$", ""))


# JSON ------------------------------------------------------------------------

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^\s"\[\]{}]')
_OPEN, _CLOSE = "[{", "]}"


def _depth(line: str, depth: int = 0) -> int:
    """Bracket depth after the line; no JSON text has a line end inside a string."""
    for token in _TOKEN.findall(line):
        depth += (token in _OPEN) - (token in _CLOSE)
    return depth


class JsonLayout:
    """The form of each file and the depth each split begins with."""

    def __init__(self, df: DataFrame):
        def note(_, own):
            first, whole, filled, depth = None, False, 0, 0
            for line in own:
                bare = line.strip(" \t\r\ufeff")
                if not bare:
                    continue
                change = _depth(bare)
                if first is None:
                    first, whole = bare[0], change == 0
                depth, filled = depth + change, filled + 1
            return {"first": first, "whole": whole, "filled": filled, "depth": depth}

        self.df = df
        self.splits = layout(df, note, "first string, whole boolean, filled bigint, depth bigint")
        self.starts, by_file = {}, {}
        for s in self.splits:
            own = by_file.setdefault(s["file"], {"first": None, "filled": 0, "depth": 0})
            self.starts[s["file"], s["block"]] = own["depth"]
            if own["first"] is None and s["first"]:
                own["first"], own["whole"] = s["first"], s["whole"]
            own["filled"] += s["filled"]
            own["depth"] += s["depth"]
        #: ``lines`` (an object per line), ``one`` (one object), ``array`` or ``empty``.
        self.forms = {}
        for file, own in by_file.items():
            if own["first"] is None:
                self.forms[file] = "empty"
            elif own["depth"]:
                raise ValueError(f"the brackets of {file} do not close")
            elif own["first"] == "[":
                self.forms[file] = "array"
            elif own["first"] == "{":
                self.forms[file] = "lines" if own["whole"] and own["filled"] > 1 else "one"
            else:
                raise ValueError(f"{file} holds neither an array nor objects")

    def files(self, *forms: str) -> list[str]:
        return [f for f, form in self.forms.items() if form in forms]

    def elements(self) -> DataFrame:
        """``(file, record)``: the objects of array files."""

        def reader(depth, block, own):
            held, kind = [], "head" if depth > 1 else "whole"
            ended = block > 0 and depth == 0
            for line in own:
                begin = 0
                for m in _TOKEN.finditer(line.lstrip("\ufeff")):
                    token = m[0]
                    if depth == 0:
                        if token != "[" or ended:
                            raise ValueError(f"text follows the array: {line.strip()[:80]!r}")
                        depth = 1
                    elif depth == 1 and token == "{":
                        depth, begin = 2, m.start()
                    elif depth == 1 and token == "]":
                        depth, ended = 0, True
                    elif depth == 1:
                        if token != ",":
                            raise ValueError(f"an element is not an object: {line.strip()[:80]!r}")
                    else:
                        depth += (token in _OPEN) - (token in _CLOSE)
                        if depth == 1:
                            held.append(line.lstrip("\ufeff")[begin : m.end()])
                            yield kind, " ".join(held)
                            held, kind = [], "whole"
                if depth > 1:
                    held.append(line.lstrip("\ufeff")[begin:])
            if held:
                yield ("through" if kind == "head" else "tail"), " ".join(held)

        arrays = self.files("array")
        starts = {k: v for k, v in self.starts.items() if self.forms[k[0]] == "array"}
        return cut(_of(self.df, arrays), starts, reader, " ", inside=2)

