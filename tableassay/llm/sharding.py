"""Sharding by proportional stratified interleaving.

Each source's rows are put in a seeded order and get a fractional rank: the r-th of n
rows stands at (r - offset) / n, where the seeded offset of the source, from 0 to 1,
keeps small sources from meeting in one place. Sorted by fractional rank, the sources
interleave as in the whole table, and equal cuts give shards whose row counts are at
most one apart and which each hold their share of every source: up to one row for each
end of the cut, and where many sources have fewer rows than there are shards, up to the
chance by which their places bunch.

Neither order is made in one task. A source is split by the draw of its rows into about
as many parts as a part has rows, and so is the line of fractional ranks; rows are
ranked inside a part, and the counts of the parts before are added. A hot source meets
in no task. Built of DataFrame functions only; every draw depends on the row's content
alone, so reruns and lost executors give the same shards.

Defined cases: a null text is as an empty one (16 bytes, crc32 0); a null source is a
source of its own; a null doc_id draws as empty text; repeated rows follow each other in
any order, ties are broken by doc_id, size and crc32; an empty table gives an empty
result; with fewer rows than shards some shards stay empty; columns of the input
that clash with the results are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableassay.llm.shared import aside, staged

SHARDS = 40
SEED = "shard-1"
OVERHEAD = 16
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draw(*parts: Column) -> Column:
    """52 seeded bits of the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def _unit(draw: Column) -> Column:
    return draw / F.lit(float(1 << 52))


def _cut(rows: DataFrame, count: str, place: Column) -> DataFrame:
    """``rows`` with ``_part``: their place (0 to 1) on a line of ``count`` rows, cut into
    about the square root of that many parts."""
    parts = F.ceil(F.sqrt(F.col(count))).cast("long")
    return rows.withColumn("_part", F.greatest(F.lit(0), F.least(F.floor(place * parts).cast("long"), parts - 1)))


def _before(cut: DataFrame, group: list[str]) -> DataFrame:
    """Per part the rows of its group in earlier parts; only counts meet in the window."""
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    return sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def _numbered(cut: DataFrame, before: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Rank (from 1) in the group, by part and then order."""
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    ranked = cut.withColumn("_rank", inside).join(before, [*group, "_part"])
    return ranked.withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def _ranked(rows: DataFrame, group: list[str], count: str, place: Column, order: list[str], name: str) -> DataFrame:
    cut = _cut(rows, count, place)
    return _numbered(cut, _before(cut, group), group, order, name)


def _positions(rows: DataFrame, places: DataFrame, total: int) -> DataFrame:
    """``rows`` with their position ``_p`` (from 1) by fractional rank among ``total``;
    ``places`` has the same ranks without the other columns."""
    cut, line = (_cut(df.withColumn("_all", F.lit(total)), "_all", F.col("_at")) for df in (rows, places))
    return _numbered(cut, _before(line, []), [], ["_at", "_source", "_r"], "_p")


def _interleaved(rows: DataFrame, per: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their fractional rank ``_at``; ``order`` breaks ties of the draw."""
    rows = _ranked(rows.join(per, "_source"), ["_source"], "_rows", _unit(F.col("_draw")), ["_draw", *order], "_r")
    return rows.withColumn("_at", (F.col("_r") - F.col("_shift")) / F.col("_rows"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``)."""
    kept = [c for c in docs.columns if c not in RESULTS]
    plain, back = aside(docs.select(kept), "doc_id", "text", "source")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = plain.withColumns({
        "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        "text_crc32": F.crc32(text),
        # the null source keeps a name of its own
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        "_draw": _draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
    })
    per = rows.groupBy("_source").agg(F.count("*").alias("_rows")).withColumn("_shift", _unit(_draw(F.lit(seed + ":of"), F.col("_source"))))
    # one row per source: written first, so that Spark knows its size before it plans the join
    per = staged(per, "shard-sources")
    total = per.agg(F.sum("_rows")).first()[0] or 0

    # fractional ranks fall into parts alike whatever breaks the ties: counted without the texts
    places = _interleaved(rows.select("_source", "_draw"), per, [])
    rows = _interleaved(rows, per, ["doc_id", "size", "text_crc32"])
    rows = _positions(rows, places, total)
    rows = rows.withColumn("_shard", F.expr(f"((_p - 1) * {shards}) div {max(total, 1)}"))
    return rows.select(
        *back,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_p - 1 - (_shard * {total} + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, files: int | None = None) -> None:
    """One folder per shard below ``path``, rows in order of slot from file to file.

    Files are ranges of (shard, slot), so a shard larger than a task's memory has several."""
    spark = docs.sparkSession
    files = files or max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = assign(docs, shards, seed)
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return assign(docs.select("doc_id", "text", "source"), shards, seed).select("doc_id", *RESULTS)
