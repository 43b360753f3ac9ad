"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"

#: The tables that the operators now running have written, by operator.
_open: list[list[str]] = []


#: The folder made where the session names none.
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new path below the session's checkpoint folder; a local one only on a single machine without that setting."""
    root = spark.conf.get(FOLDER, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {FOLDER} to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="run-"))
        root = _own[0]
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and read back from the shared folder."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write an operator's result, and remove the tables that it wrote on the way."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        paths: list[str] = []
        _open.append(paths)
        try:
            result = operator(df, *args, **options)
            _open[-1:] = []
            out = written(result)
        finally:
            if _open and _open[-1] is paths:
                _open.pop()
            for path in paths:
                remove(df.sparkSession, path)
        return out

    return run
