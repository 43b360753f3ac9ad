"""File stream from a landing directory into the streaming bronze table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tickframe.schemas import BAR_SCHEMA
from tickframe.sinks import exists

BATCH_BYTES = 64 << 30
CORRUPT = "_corrupt_record"


def read_landing(
    spark: SparkSession, path: str, max_files: int | None = None, schema: StructType = BAR_SCHEMA, keep_corrupt: bool = False
) -> DataFrame:
    """Stream of landed bars. A drop is a directory, so look-up is recursive.

    A batch takes at most ``max_files`` files, or BATCH_BYTES where that is not
    given. Drops stay where they are; a landing area that should not grow takes
    the ``cleanSource`` option of the file source.

    A feed that gains columns is read with a wider ``schema`` (see ``grown_schema``):
    older drops give NULL there, and the same checkpoint and table go on.
    ``keep_corrupt`` adds the text of lines that are no record of the schema.
    """
    if keep_corrupt:
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", CORRUPT)
    if max_files is None:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    else:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("processing_timestamp", F.current_timestamp())


def write_bronze(
    stream: DataFrame, path: str, checkpoint: str, partitions: Sequence[str] = ("ingestion_date",)
) -> StreamingQuery:
    """Start an append of everything available; the checkpoint makes it exactly-once.

    Rows are brought together by partition value, so that a batch writes a file
    or a few per value and not one per task and value. The rebalance splits a
    value that holds a large share of the rows over several tasks.
    """
    clustered = stream.hint("rebalance", *partitions) if partitions else stream
    return (
        clustered.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .partitionBy(*partitions)
        .trigger(availableNow=True)
        .start()
    )


@dataclass(frozen=True)
class Ingested:
    """What one run of the stream did: rows read from the drops, rows and bytes of the files it committed, and when."""

    rows_read: int
    rows_written: int
    bytes_written: int
    start: datetime
    end: datetime


def committed(spark: SparkSession, path: str, since: datetime | None = None) -> tuple[int, int]:
    """Rows and bytes of a stream's table, of the files committed from ``since`` on.

    Both are read back from the files in the table's own log, not from counters of tasks: a task or batch that was
    tried again counts once.
    """
    if not exists(spark, f"{path}/_spark_metadata"):
        return 0, 0
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at"))
    if since is not None:
        files = files.where(F.col("at") >= F.lit(since))
    each = files.groupBy("file").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    row = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def ingest_available(
    spark: SparkSession, landing: str, path: str, checkpoint: str,
    partitions: Sequence[str] = ("ingestion_date",), max_files: int | None = None, schema: StructType = BAR_SCHEMA,
    quarantine: str | None = None,
) -> Ingested:
    """Ingest the drops not seen yet, wait, and say what was done.

    With ``quarantine``, lines that are no record of the schema go there with their text, by a stream of its own that is
    exactly-once as well, and not into the table; without, they give rows of NULLs.
    """
    start = datetime.now()
    drops = read_landing(spark, landing, max_files, schema, keep_corrupt=quarantine is not None)
    if quarantine is not None:
        is_corrupt = F.col(CORRUPT).isNotNull()
        # With all columns: a line is only held against those that are asked for.
        broken = write_bronze(drops.where(is_corrupt), quarantine, f"{checkpoint}-quarantine", ())
        drops = drops.where(~is_corrupt).drop(CORRUPT)
    query = write_bronze(drops, path, checkpoint, partitions)
    query.awaitTermination()
    if quarantine is not None:
        broken.awaitTermination()
    read = sum(p.numInputRows for p in query.recentProgress)
    rows, size = committed(spark, path, start)
    return Ingested(read, rows, size, start, datetime.now())


def grown_schema(spark: SparkSession, landing: str, log: str, base: StructType = BAR_SCHEMA) -> StructType:
    """``base`` with all columns that the feed has had, in the order in which they came.

    Each call looks only at the drops that came after the last one, and adds the columns it finds to the log below
    ``log`` with their types; known columns keep theirs.
    """
    known, since = base, None
    if exists(spark, log):
        for row in spark.read.json(log, schema="version long, at string, columns string").orderBy("version").collect():
            known = StructType([*known.fields, *StructType.fromJson(json.loads(row["columns"])).fields])
            since = row["at"]
    at = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    reader = spark.read.option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", CORRUPT)
    try:
        found = (reader if since is None else reader.option("modifiedAfter", since)).json(landing).schema.fields
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = []
    new = [f for f in found if f.name not in known.fieldNames() and f.name != CORRUPT]
    version = [(len(known.fields) + len(new), at, json.dumps(StructType(new).jsonValue()))]
    spark.createDataFrame(version, "version long, at string, columns string").coalesce(1).write.mode("append").json(log)
    return StructType([*known.fields, *new])
