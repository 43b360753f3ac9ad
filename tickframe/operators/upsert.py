"""Upsert for tables without row-level MERGE."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.sinks import clustered, delete, exists, overwrite_partitions, write_table


class DuplicateSourceKeys(ValueError):
    """Several source rows match one key, so the update is ambiguous."""


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    clash = df.groupBy(*keys).count().where("count > 1").select(*keys).first()
    if clash is not None:
        raise DuplicateSourceKeys(f"source has several rows for {clash.asDict()}")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Source rows, plus the target rows whose key the source does not hold."""
    if check:
        require_unique(source, keys)
    untouched = target.join(source.select(*keys), list(keys), "left_anti")
    return source.unionByName(untouched, allowMissingColumns=True).select(
        *target.columns, *[c for c in source.columns if c not in target.columns]
    )


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with all columns it ever had, or None where no write has been completed or no row written yet.

    A write that stopped between its files leaves no mark of success, so it does not pass for a table; the file stream
    keeps a log of its own instead.
    """
    if not any(exists(spark, f"{path}/{mark}") for mark in ("_SUCCESS", "_spark_metadata")):
        return None
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _swap(spark: SparkSession, path: str, partition: str, staging: str, cluster: bool) -> None:
    """Replace the partitions of the table by the source's rows and those kept of the table; may be repeated."""
    source, kept = (spark.read.option("mergeSchema", "true").parquet(f"{staging}/{name}") for name in ("source", "kept"))
    columns = [*kept.columns, *[c for c in source.columns if c not in kept.columns]]
    merged = source.unionByName(kept, allowMissingColumns=True).select(*columns)
    overwrite_partitions(clustered(merged, (partition,)) if cluster else merged, path, (partition,))
    delete(spark, f"{staging}/kept")


def recover(spark: SparkSession, path: str, partition: str, staging: str, cluster: bool = True) -> bool:
    """Finish an upsert that stopped while it replaced partitions; says whether there was one."""
    pending = exists(spark, f"{staging}/kept/_SUCCESS")
    if pending:
        _swap(spark, path, partition, staging, cluster)
    return pending


def _without(target: DataFrame, source: DataFrame, keys: Sequence[str], staged: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Target rows whose key the source does not hold.

    The keys alone are compared first. Then the target is joined with the fewer of them, those that stay or the
    source's: where a source replaces most of a table, no row of the table has to travel.
    """
    held = source.select(*keys)
    stay = staged(target.select(*keys).join(held, list(keys), "left_anti"), "stay")
    if 2 * stay.count() > target.count():
        return target.join(held, list(keys), "left_anti")
    named = stay.select(*[F.col(k).alias(f"_stay_{k}") for k in keys]).distinct()
    return target.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_stay_{k}")) for k in keys]), "left_semi")


def upsert_table(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition: str, staging: str,
    check: bool = True, cluster: bool = True,
) -> None:
    """Create a Parquet table, or upsert into it rewriting only touched partitions.

    ``partition`` must follow from the keys (say, the month of the date), so that
    a matching row can only live in a partition the source names. The source is
    written to ``staging`` first, so its plan runs once, and so are the rows of the
    touched partitions that it does not replace: the swap then reads nothing of the
    table it replaces. Staged rows are read whole, so only the swap brings them
    together by partition, or, without ``cluster``, writes a file a task and
    partition. A call with the same ``staging`` folder first finishes the swap of one
    that was interrupted; use one folder per table, and one writer at a time. Columns
    that only the table or only the source has are kept, with NULL for the other.
    ``check`` may be dropped for a source that is unique by construction.
    """
    recover(spark, path, partition, staging, cluster)

    def staged(df: DataFrame, name: str) -> DataFrame:
        write_table(df, f"{staging}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staging}/{name}")

    target = read_if_exists(spark, path)
    if target is None:
        if check:
            require_unique(source, keys)
        write_table(source, path, (partition,), cluster=cluster)
        return
    source = staged(source, "source")
    # As literals, the partition values prune the scan of the target. There are at
    # most as many as the table has directories.
    touched = [row[0] for row in source.select(partition).distinct().collect()]
    if not touched:
        return
    held = F.col(partition).isin([v for v in touched if v is not None])
    if None in touched:
        held = held | F.col(partition).isNull()
    if check:
        require_unique(source, keys)
    staged(_without(target.where(held), source, keys, staged), "kept")
    _swap(spark, path, partition, staging, cluster)
