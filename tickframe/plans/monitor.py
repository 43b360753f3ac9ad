"""Audit rows and monitoring reports."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.functions.numeric import COUNT, count_where, mean, ratio
from tickframe.functions.windows import top_per_group
from tickframe.operators.quality import TableChecks
from tickframe.schemas import LAYER_METRICS, PIPELINE_RUNS
from tickframe.streaming.ingest import Ingested

# Limits of the bottleneck report.
VARIANCE_FACTOR = 2
SLOW_SECONDS = 300
SUMMARY_CHARS = 100

SECONDS = "decimal(18,6)"


def _seconds(c: str, digits: int) -> Column:
    return F.round(F.avg(F.col(c).cast(SECONDS)), digits).cast("double")


def _conform(df: DataFrame, values: dict[str, Column], schema) -> DataFrame:
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schema])


def _profile(
    counted: DataFrame, *, run_id: str, layer: str | Column, table: str | Column, start: datetime, end: datetime,
    operation: str = "INSERT", status: str = "SUCCESS", error: str | None = None, rows_updated: int = 0, rows_deleted: int = 0,
) -> DataFrame:
    """Audit rows from rows of ``written`` and ``read`` counts, and ``bytes_written`` and ``bytes_read`` where they are known."""
    def known(name: str) -> Column:
        return F.col(name) if name in counted.columns else F.lit(0)

    layer, table = (F.lit(x) if isinstance(x, str) else x for x in (layer, table))
    values = {
        "metric_id": F.concat_ws(":", F.lit(run_id), table, F.lit(operation)),
        "run_id": F.lit(run_id),
        "layer_name": layer,
        "table_name": table,
        "operation": F.lit(operation),
        "rows_read": F.col("read"),
        "rows_written": F.col("written"),
        "rows_updated": F.lit(rows_updated),
        "rows_deleted": F.lit(rows_deleted),
        "bytes_read": known("bytes_read"),
        "bytes_written": known("bytes_written"),
        "start_time": F.lit(start),
        "end_time": F.lit(end),
        "duration_seconds": F.lit((end - start).total_seconds()),
        "status": F.lit(status),
        "error_message": F.lit(error),
        "processing_date": F.lit(start.date()),
        "created_at": F.lit(end),
    }
    return _conform(counted, values, LAYER_METRICS)


def layer_profile(df: DataFrame, *, rows_read: DataFrame | None = None, **run) -> DataFrame:
    """Audit row of one written table; Spark counts the rows.

    ``rows_read`` is the input whose rows are counted, none meaning no input table.
    """
    read = F.lit(0) if rows_read is None else rows_read.agg(F.count(F.lit(1))).scalar()
    return _profile(df.agg(F.count(F.lit(1)).alias("written")).withColumn("read", read), **run)


def ingest_profile(spark: SparkSession, done: Ingested, *, run_id: str, layer: str, table: str, operation: str = "APPEND") -> DataFrame:
    """Audit row of one run of the file stream."""
    counted = spark.createDataFrame(
        [(done.rows_read, done.rows_written, done.bytes_written)], "read long, written long, bytes_written long"
    )
    return _profile(counted, run_id=run_id, layer=layer, table=table, start=done.start, end=done.end, operation=operation)


def run_summary(metrics: DataFrame, *, run_name: str, run_type: str, triggered_by: str) -> DataFrame:
    """One row per run from its layer metrics."""
    failed = F.col("status") == "FAILED"

    def rows_of(layer: str) -> Column:
        written = F.sum(F.when(F.col("layer_name") == layer, F.col("rows_written")))
        return F.coalesce(written, F.lit(0)).alias(f"{layer}_rows_in")

    # Texts are aggregated apart, for failed rows only: the rest then hashes.
    errors = metrics.where(failed).groupBy("run_id").agg(F.min("error_message").alias("error_message"))
    per_run = metrics.groupBy("run_id").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max(failed).alias("any_failed"),
        rows_of("bronze"),
        rows_of("silver"),
        rows_of("gold"),
        F.max("processing_date").alias("processing_date"),
        F.max("created_at").alias("created_at"),
    ).join(errors, "run_id", "left")
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    values = {name: F.col(name) for name in per_run.columns} | {
        "run_name": F.lit(run_name),
        "run_type": F.lit(run_type),
        "duration_seconds": seconds,
        "status": F.when(F.col("any_failed"), "FAILED").otherwise("SUCCESS"),
        "triggered_by": F.lit(triggered_by),
    }
    return _conform(per_run, values, PIPELINE_RUNS)


WALK = (
    TableChecks("bronze", "bronze.stock_prices_raw", ("ticker", "date", "close"), 0.01, ("ticker", "date"), 0.01),
    TableChecks("silver", "silver.stock_prices_clean", ("ticker_standard", "date"), 0.001),
    TableChecks("gold", "gold.stock_daily_metrics", sla_hours=48),
)


def monitored_walk(
    bronze: DataFrame, silver: DataFrame, gold: DataFrame, *, run_id: str, as_of: datetime
) -> dict[str, DataFrame]:
    """Metrics, checks and freshness of the three layers, as audit rows.

    Each of the three results scans each table once: all counts of a table come from one aggregate. A layer's rows read
    are the rows of the layer before.
    """
    stats = [(c, c.stats(df, as_of)) for c, df in zip(WALK, (bronze, silver, gold))]
    counted = reduce(
        DataFrame.unionByName,
        [s.select(F.lit(k).alias("step"), F.lit(c.layer).alias("layer"), F.lit(c.table).alias("table"), F.col("records").alias("written"))
         for k, (c, s) in enumerate(stats)],
    )
    # A row a layer.
    before = F.lag("written", 1, 0).over(Window.orderBy("step"))
    metrics = _profile(counted.withColumn("read", before), run_id=run_id, layer=F.col("layer"), table=F.col("table"), start=as_of, end=as_of)
    checks = [rows for c, s in stats if (rows := c.checks(s, run_id, as_of)) is not None]
    fresh = [c.freshness(s, as_of) for c, s in stats]
    return {"metrics": metrics, "checks": reduce(DataFrame.unionByName, checks), "freshness": reduce(DataFrame.unionByName, fresh)}


def _since(c: str, as_of: date, days: int) -> Column:
    return F.col(c) >= F.lit(as_of - timedelta(days=days)).cast("timestamp")


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    return (
        runs.orderBy(F.desc("start_time"), F.desc("run_id"))
        .limit(k)
        .select(
            "run_name", "run_type", "status", "processing_date", "start_time", "duration_seconds",
            "bronze_rows_in", "silver_rows_in", "gold_rows_in", "triggered_by",
            F.substring("error_message", 1, SUMMARY_CHARS).alias("error_summary"),
        )
    )


def success_rate(runs: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    total, good = F.count(F.lit(1)), count_where(F.col("status") == "SUCCESS")
    return (
        runs.where(_since("start_time", as_of, days))
        .groupBy("run_name")
        .agg(
            total.alias("total_runs"),
            good.alias("successful_runs"),
            count_where(F.col("status") == "FAILED").alias("failed_runs"),
            F.round(good * F.lit(100.0) / total, 2).alias("success_rate_pct"),
            _seconds("duration_seconds", 2).alias("avg_duration_seconds"),
            F.round(F.min("duration_seconds"), 2).alias("min_duration_seconds"),
            F.round(F.max("duration_seconds"), 2).alias("max_duration_seconds"),
        )
        .orderBy(F.desc("total_runs"), F.asc("run_name"))
    )


def layer_performance(metrics: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    written = F.sum("rows_written")
    elapsed = F.sum(F.col("duration_seconds").cast(SECONDS)).cast("double")
    return (
        metrics.where(_since("start_time", as_of, days))
        .groupBy("layer_name", "table_name")
        .agg(
            F.count(F.lit(1)).alias("execution_count"),
            written.alias("total_rows_written"),
            mean("rows_written", 0, COUNT).alias("avg_rows_written"),
            _seconds("duration_seconds", 2).alias("avg_duration_seconds"),
            F.round(ratio(written, elapsed), 0).alias("avg_throughput_rows_per_sec"),
            count_where(F.col("status") == "SUCCESS").alias("successful_runs"),
            count_where(F.col("status") == "FAILED").alias("failed_runs"),
        )
        .orderBy("layer_name", "table_name")
    )


def quality_issues(checks: DataFrame, as_of: date, days: int = 7, k: int = 20) -> DataFrame:
    return (
        checks.where(F.col("check_result").isin("FAIL", "WARNING") & _since("checked_at", as_of, days))
        .orderBy(F.desc("checked_at"), F.desc("failure_rate"), F.desc("check_id"))
        .limit(k)
        .select(
            "checked_at", "layer_name", "table_name", "check_name", "check_type", "check_result",
            "failure_rate", "threshold", "records_checked", "records_failed",
        )
    )


def current_freshness(freshness: DataFrame) -> DataFrame:
    order = [F.desc("checked_at"), F.desc("freshness_id")]
    return (
        top_per_group(freshness, ["table_name"], order, 1, "rn")
        .orderBy("layer_name", "table_name")
        .select(
            "layer_name", "table_name", "latest_data_date",
            F.round("data_latency_hours", 1).alias("latency_hours"),
            F.col("freshness_sla_hours").alias("sla_hours"),
            F.when(F.col("is_fresh"), "FRESH").otherwise("STALE").alias("freshness_status"),
            "record_count",
            F.col("checked_at").alias("last_checked"),
        )
    )


def bottlenecks(metrics: DataFrame, as_of: date, days: int = 30, k: int = 10) -> DataFrame:
    elapsed = F.sum(F.col("duration_seconds").cast(SECONDS)).cast("double")
    average = ratio(elapsed, F.count("duration_seconds").cast("double"))
    longest = F.max("duration_seconds")
    return (
        metrics.where(_since("start_time", as_of, days) & (F.col("status") == "SUCCESS"))
        .groupBy("layer_name", "table_name")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            _seconds("duration_seconds", 2).alias("avg_duration_sec"),
            F.round(longest, 2).alias("max_duration_sec"),
            mean("rows_written", 0, COUNT).alias("avg_rows_written"),
            F.round(ratio(mean("rows_written", dtype=COUNT), average), 0).alias("avg_throughput"),
            F.when(longest > VARIANCE_FACTOR * average, "HIGH VARIANCE")
            .when(average > SLOW_SECONDS, "SLOW")
            .otherwise("OK")
            .alias("performance_flag"),
        )
        .orderBy(F.desc("avg_duration_sec"), F.asc("layer_name"), F.asc("table_name"))
        .limit(k)
    )
