"""Folders and intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tickframe.sinks import write_table

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint directory.

    Where none is configured, as in tests, a local one is made; executors on
    other machines could not read that, so a cluster must name one.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/tickframe-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and read back from the shared folder: lost executors cost a re-read."""
    path = shared_folder(df.sparkSession)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
