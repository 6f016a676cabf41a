import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@pytest.fixture
def gappy(spark):
    """NULL beside NaN, a constant, an empty column, text, a boolean, a date, an array."""
    return spark.sql(
        """
        SELECT CAST(id AS INT) AS id,
               CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN double('NaN') ELSE id * 1.5D END AS x,
               CASE WHEN id % 4 = 0 THEN NULL ELSE float(id * id) END AS y,
               CAST(3 AS INT) AS same,
               CAST(NULL AS DOUBLE) AS nothing,
               CASE WHEN id % 3 = 0 THEN NULL ELSE concat('v', id % 4) END AS word,
               id % 2 = 0 AS flag,
               DATE'2024-01-01' + CAST(id AS INT) AS day,
               array(id) AS list
        FROM range(50)
        """
    )


def rows(df, *key):
    """Rows by their first column, or by the named ones."""
    key = key or (df.columns[0],)
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in key)
        out[k[0] if len(k) == 1 else k] = r
    return out


@pytest.fixture
def by():
    return rows
