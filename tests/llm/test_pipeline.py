"""The corpus pipeline as a whole, and line dedup when the scan is split anew."""

import pytest

import corpus_pipeline
from tableassay.llm import line_dedup


def test_deletions_stay_on_their_rows_when_the_scan_is_split_anew(spark, tmp_path):
    run = "\n".join(f"line {i} with a few words of its own kind" for i in range(12))
    rows = [(i, run if i in (17, 40) else "\n".join(f"text {i} line {j} alone" for j in range(30))) for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id").write.parquet(str(tmp_path / "docs"))
    session = spark.newSession()
    docs = session.read.parquet(str(tmp_path / "docs"))
    out = line_dedup.deduplicate(docs)
    # fewer, larger splits from here on
    session.conf.set("spark.sql.files.minPartitionNum", "1")
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    assert docs.rdd.getNumPartitions() == 1
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in out.collect()}
    assert got == {i: (12, "") if i == 40 else (0, t) for i, t in rows}


@pytest.fixture(scope="module")
def mixed(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def test_pipeline_runs_all_stages(spark, sf_dir, mixed):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = mixed.collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) <= set(docs) and len(ids) > len(docs) / 2
    texts = [" ".join(docs[i]["text"].split()).lower() for i in ids]
    assert len(texts) == len(set(texts))
    assert all(r["source"] == docs[r["doc_id"]]["source"] and 0 < r["taken"] <= 2 * r["size"] for r in rows)


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
