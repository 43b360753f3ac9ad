"""Table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of all tables but those that the file stream and the audit append to.
COMPRESSION = "zstd"


def clustered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of equal ``columns`` brought together, for a write into their folders.

    The rebalance hint lets adaptive execution merge small and split large
    shuffle partitions, so their number need not follow the input. It stays at or
    below ``spark.shuffle.sort.bypassMergeThreshold``: up to there a map task
    appends its rows to a file per partition, beyond it holds them all in memory
    to sort them, and spills whole rows where its share of the input is large.
    """
    spark = df.sparkSession
    most = max(1, int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")))
    return df.hint("rebalance", min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def write_table(
    df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite", cluster: bool = True
) -> None:
    """Write Parquet, clustered by the partition columns if there are any.

    So there is no file per task and partition value, and a value with a large
    share of the rows is written by several tasks. Without partition columns the
    rows are written where they are, without a shuffle; with ``cluster`` off also
    into folders, of which there must be few: a task writes a file into each it has
    rows for. Shuffled, a row takes about twice the bytes it takes when written.
    """
    rows = clustered(df, partitions) if partitions and cluster else df
    rows.write.mode(mode).option("compression", COMPRESSION).partitionBy(*partitions).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, order: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Write a catalog table in hash buckets of ``key``, each sorted by key and ``order``, and read it back.

    A join on the key with a table of as many buckets, and a window over the key's series, then need no exchange.
    The rows are dealt by the same hash first, unless they are ``dealt`` so already: a bucket is one file. Choose the
    number so that a bucket fits a task.
    """
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.mode("overwrite").option("path", path).option("compression", COMPRESSION).bucketBy(buckets, key).sortBy(key, order).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def append_bars(df: DataFrame, path: str, partitions: Sequence[str] = ("ingestion_date",)) -> None:
    """Append bronze bars."""
    write_table(df, path, partitions, "append")


def overwrite_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``; its rows are written where they are, so those of many partitions are clustered before."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy(*partitions)
        .parquet(path)
    )


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit rows; a handful of rows need no shuffle."""
    df.write.mode("append").parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours, such as a staging folder that has served."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def export_daily_json(df: DataFrame, path: str, day: str = "date") -> None:
    """One directory of JSON per trading day, all days in one distributed job.

    Days that ``df`` does not hold stay as they are. The directory name is a
    copy: the files keep the day as a field. They are compressed: as plain text
    they would be by far the largest copy of the bars.
    """
    (
        df.withColumn("drop_date", F.to_date(day))
        .hint("rebalance", "drop_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip")
        .partitionBy("drop_date")
        .json(path)
    )
