"""Session helpers: where jobs may put files that every executor must reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``.
    A local folder is made only when the session runs in one JVM and names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jdir.get() if jdir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tableassay-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
