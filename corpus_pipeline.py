"""The corpus pipeline: documents through five operators, each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableassay.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from tableassay.llm.shared import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language."""
    return language_id.known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier; those with no line left go."""
    return line_dedup.shortened(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words of each document are taken; those of which none is taken go."""
    return mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near", near),
    ("leaks", leaks),
    ("mix", mix),
]

#: No SQL: the language stage parses with suffix automata.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
