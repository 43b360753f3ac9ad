"""Declared schemas of the lakehouse tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def _fields(ddl: list[tuple[str, T.DataType, bool, str]]) -> T.StructType:
    return T.StructType(
        [T.StructField(n, t, nullable, {"comment": c}) for n, t, nullable, c in ddl]
    )


STR, TS, DBL, LNG = T.StringType(), T.TimestampType(), T.DoubleType(), T.LongType()
DATE, BOOL, INT = T.DateType(), T.BooleanType(), T.IntegerType()

BAR_SCHEMA = _fields([
    ("ticker", STR, True, "symbol as delivered by the feed"),
    ("date", TS, True, "trading day of the bar"),
    ("open", DBL, True, "first price"),
    ("high", DBL, True, "highest price"),
    ("low", DBL, True, "lowest price"),
    ("close", DBL, True, "last price"),
    ("volume", LNG, True, "units traded"),
    ("ingestion_timestamp", TS, True, "time the bar was landed"),
    ("source", STR, True, "feed the bar came from"),
    ("ingestion_date", DATE, True, "day the bar was landed"),
])
BAR_COLUMNS = BAR_SCHEMA.fieldNames()

TICKER_CONFIG = _fields([
    ("ticker_id", INT, True, "order of ingestion"),
    ("ticker_symbol", STR, True, "symbol with exchange suffix"),
    ("ticker_clean", STR, True, "symbol without suffix"),
    ("company_name", STR, True, "listed company"),
    ("sector", STR, True, "industry of the company"),
    ("is_active", BOOL, True, "whether the ticker is ingested"),
    ("added_date", DATE, True, "first day in the universe"),
    ("last_updated", TS, True, "last change of this row"),
])

SECTOR_MAP = _fields([
    ("ticker_standard", STR, False, "standardised symbol"),
    ("sector", STR, False, "sector used by the analytics tables"),
])

PIPELINE_RUNS = _fields([
    ("run_id", STR, False, "run identifier"),
    ("run_name", STR, True, "pipeline name"),
    ("run_type", STR, True, "FULL_LOAD, INCREMENTAL or BACKFILL"),
    ("start_time", TS, True, "start of the run"),
    ("end_time", TS, True, "end of the run"),
    ("duration_seconds", DBL, True, "elapsed seconds"),
    ("status", STR, True, "RUNNING, SUCCESS, FAILED or PARTIAL"),
    ("error_message", STR, True, "error text of a failed run"),
    ("triggered_by", STR, True, "user or schedule"),
    ("bronze_rows_in", LNG, True, "rows written to bronze"),
    ("silver_rows_in", LNG, True, "rows written to silver"),
    ("gold_rows_in", LNG, True, "rows written to gold"),
    ("processing_date", DATE, True, "business day processed"),
    ("created_at", TS, True, "time this row was written"),
])

LAYER_METRICS = _fields([
    ("metric_id", STR, False, "metric identifier"),
    ("run_id", STR, False, "run this metric belongs to"),
    ("layer_name", STR, True, "bronze, silver or gold"),
    ("table_name", STR, True, "table written"),
    ("operation", STR, True, "INSERT, UPDATE, DELETE or MERGE"),
    ("rows_read", LNG, True, "input rows"),
    ("rows_written", LNG, True, "output rows"),
    ("rows_updated", LNG, True, "rows updated by a merge"),
    ("rows_deleted", LNG, True, "rows deleted"),
    ("bytes_read", LNG, True, "input bytes"),
    ("bytes_written", LNG, True, "output bytes"),
    ("start_time", TS, True, "start of the step"),
    ("end_time", TS, True, "end of the step"),
    ("duration_seconds", DBL, True, "elapsed seconds"),
    ("status", STR, True, "SUCCESS or FAILED"),
    ("error_message", STR, True, "error text of a failed step"),
    ("processing_date", DATE, True, "business day processed"),
    ("created_at", TS, True, "time this row was written"),
])

DATA_QUALITY_CHECKS = _fields([
    ("check_id", STR, False, "check identifier"),
    ("run_id", STR, False, "run this check belongs to"),
    ("layer_name", STR, True, "layer of the checked table"),
    ("table_name", STR, True, "checked table"),
    ("check_name", STR, True, "name of the check"),
    ("check_type", STR, True, "NULL_CHECK or DUPLICATE_CHECK"),
    ("check_result", STR, True, "PASS, WARNING or FAIL"),
    ("records_checked", LNG, True, "rows looked at"),
    ("records_failed", LNG, True, "rows that failed"),
    ("failure_rate", DBL, True, "failed share in percent"),
    ("threshold", DBL, True, "tolerated share in percent"),
    ("check_details", STR, True, "details as JSON"),
    ("checked_at", TS, True, "time of the check"),
    ("processing_date", DATE, True, "business day"),
    ("created_at", TS, True, "time this row was written"),
])

DATA_FRESHNESS = _fields([
    ("freshness_id", STR, False, "check identifier"),
    ("table_name", STR, True, "checked table"),
    ("layer_name", STR, True, "layer of the table"),
    ("latest_data_date", DATE, True, "newest business day in the table"),
    ("latest_ingestion_time", TS, True, "newest landing time"),
    ("current_check_time", TS, True, "time of the check"),
    ("data_latency_hours", DBL, True, "age of the newest data"),
    ("is_fresh", BOOL, True, "whether the age is within the target"),
    ("freshness_sla_hours", DBL, True, "tolerated age"),
    ("record_count", LNG, True, "rows in the table"),
    ("min_date", DATE, True, "oldest business day"),
    ("max_date", DATE, True, "newest business day"),
    ("checked_at", TS, True, "time of the check"),
    ("created_at", TS, True, "time this row was written"),
])

# table name -> (schema, partition columns)
AUDIT_TABLES = {
    "pipeline_runs": (PIPELINE_RUNS, ("processing_date",)),
    "layer_metrics": (LAYER_METRICS, ("processing_date", "layer_name")),
    "data_quality_checks": (DATA_QUALITY_CHECKS, ("processing_date", "layer_name")),
    "data_freshness": (DATA_FRESHNESS, ()),
}
DIMENSION_TABLES = {
    "ticker_config": (TICKER_CONFIG, ()),
    "ticker_sector_mapping": (SECTOR_MAP, ()),
}


def create_tables(spark: SparkSession, database: str, tables=None) -> list[str]:
    """Create the declared tables as Parquet tables with comments and NOT NULLs."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = []
    for name, (schema, partitions) in (tables or {**AUDIT_TABLES, **DIMENSION_TABLES}).items():
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}"
            + ("" if f.nullable else " NOT NULL")
            + f" COMMENT '{f.metadata['comment']}'"
            for f in schema
        )
        by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{by}")
        made.append(f"{database}.{name}")
    return made
