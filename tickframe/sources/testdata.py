"""Bars, dimensions and audit tables derived from the generated test tables.

Each function is one lazy plan over whole tables: what it costs grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.schemas import (
    DATA_FRESHNESS,
    DATA_QUALITY_CHECKS,
    LAYER_METRICS,
    PIPELINE_RUNS,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per line item, with planted faults, in the bronze schema; a supplier is a ticker."""
    return _bars(_items(spark, sf_dir), F.concat(F.lit("sup"), F.col("l_suppkey").cast("string")), F.col("l_suppkey"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars under the nation of a line item's supplier: both are looked up, and a line item without them is left out."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    items = _items(spark, sf_dir).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return _bars(items, F.lower("n_name"), F.col("n_nationkey"))


def _bars(items: DataFrame, name: Column, number: Column) -> DataFrame:
    """Bars of line items, whose ticker has a name and a number.

    Prices of every other ticker rise by a thousand a day, the others fall, so that
    highs and lows of a year are reached.
    """
    key = F.col("l_orderkey")
    items = (
        items
        .withColumn("days", F.datediff("l_shipdate", F.lit("1992-01-01")))
        .withColumn("trend", F.when(number % 2 == 0, F.col("days")).otherwise(3700 - F.col("days")) * 100_000)
        .withColumn("o", _cents(F.col("l_extendedprice") / F.col("l_quantity")) + F.col("trend"))
        .withColumn("c", F.floor(F.col("o") * (1 + F.col("l_discount") - 0.05) + 0.5))
        .withColumn("spread", _cents(F.col("l_tax")) * 10)
    )
    high = F.greatest("o", "c") + F.when(key % 107 == 0, -500).otherwise(F.col("spread"))
    low = F.when(key % 103 == 0, -100).otherwise(F.least("o", "c") - F.col("spread"))
    volume = F.when(key % 109 == 0, -5).otherwise(F.col("l_quantity") * 100)
    open_ = F.when(key % 127 == 0, 0).when(key % 101 != 0, F.col("o"))
    return (
        items.select(
            F.concat(name, F.lit(".ns ")).alias("ticker"),
            F.col("l_shipdate").cast("timestamp").alias("date"),
            (open_ / 100).alias("open"),
            (high / 100).alias("high"),
            (low / 100).alias("low"),
            F.when(key % 113 != 0, F.col("c") / 100).alias("close"),
            volume.cast("long").alias("volume"),
            (F.col("l_shipdate") + F.make_dt_interval(hours=18 + F.col("l_linenumber"))).cast("timestamp").alias("ingestion_timestamp"),
            F.lit("lineitem").alias("source"),
            F.trunc("l_shipdate", "MM").alias("ingestion_date"),
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                _cents(F.col("l_extendedprice")).cast("long"),
            ).alias("record_id"),
        )
    )


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the name of their region as ``sector``."""
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select("s_suppkey", "s_nationkey", F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string")).alias("name"), F.col("r_name").alias("sector"))


def ticker_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select(
        (F.col("s_suppkey") + 1).cast("int").alias("ticker_id"),
        F.concat("name", F.lit(".NS")).alias("ticker_symbol"),
        F.col("name").alias("ticker_clean"),
        F.concat(F.lit("Co "), "name").alias("company_name"),
        "sector",
        (F.col("s_suppkey") % 7 != 6).alias("is_active"),
        F.to_date(F.lit("2024-01-01")).alias("added_date"),
        F.to_timestamp(F.lit("2024-01-01")).alias("last_updated"),
    )


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but every ninth supplier, so that some tickers have no sector."""
    return _suppliers(spark, sf_dir).where("s_suppkey % 9 <> 8").select(F.col("name").alias("ticker_standard"), "sector")


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    status = (
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "O", "FAILED")
        .otherwise("RUNNING")
    )
    kind = F.col("o_custkey") % 3
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderpriority").alias("run_name"),
        F.when(kind == 0, "FULL_LOAD").when(kind == 1, "INCREMENTAL").otherwise("BACKFILL").alias("run_type"),
        start.alias("start_time"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.floor(F.col("o_totalprice") / 1000))).alias("end_time"),
        (F.col("o_totalprice") / 1000).alias("duration_seconds"),
        status.alias("status"),
        F.when(status == "FAILED", F.rpad(F.concat(F.lit("run "), F.col("o_orderkey").cast("string"), F.lit(" failed ")), 150, ".")).alias("error_message"),
        F.lit("scheduler").alias("triggered_by"),
        F.col("o_custkey").alias("bronze_rows_in"),
        (F.col("o_custkey") * 2).alias("silver_rows_in"),
        (F.col("o_custkey") * 3).alias("gold_rows_in"),
        F.to_date("o_orderdate").alias("processing_date"),
        start.alias("created_at"),
    )
    return _conform(df, PIPELINE_RUNS)


def layer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = (
        F.when(F.col("l_returnflag") == "R", "bronze")
        .when(F.col("l_returnflag") == "A", "silver")
        .otherwise("gold")
    )
    rows = F.col("l_quantity") * 1000
    start = F.col("l_shipdate").cast("timestamp")
    df = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("metric_id"),
        F.col("l_orderkey").cast("string").alias("run_id"),
        layer.alias("layer_name"),
        F.concat(layer, F.lit(".t"), (F.col("l_suppkey") % 5).cast("string")).alias("table_name"),
        F.lit("INSERT").alias("operation"),
        rows.alias("rows_read"),
        rows.alias("rows_written"),
        F.lit(0).alias("rows_updated"),
        F.lit(0).alias("rows_deleted"),
        F.lit(0).alias("bytes_read"),
        F.lit(0).alias("bytes_written"),
        start.alias("start_time"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.floor(F.col("l_extendedprice") / 100))).alias("end_time"),
        (F.col("l_extendedprice") / 100).alias("duration_seconds"),
        F.when(F.col("l_linestatus") == "F", "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(F.col("l_linestatus") != "F", F.concat(F.lit("step "), F.col("l_linenumber").cast("string"), F.lit(" failed"))).alias("error_message"),
        F.to_date("l_shipdate").alias("processing_date"),
        start.alias("created_at"),
    )
    return _conform(df, LAYER_METRICS)


def data_quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.element_at(F.array(F.lit("bronze"), F.lit("silver"), F.lit("gold")), (F.col("user_id") % 3 + 1).cast("int"))
    at = F.col("ts").cast("timestamp")
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("check_id"),
        F.col("user_id").cast("string").alias("run_id"),
        layer.alias("layer_name"),
        F.concat(layer, F.lit(".t"), (F.col("user_id") % 10).cast("string")).alias("table_name"),
        F.concat(F.lit("Check: "), "event_type").alias("check_name"),
        F.upper("event_type").alias("check_type"),
        F.when(F.col("value") > 50, "FAIL").when(F.col("value") > 40, "WARNING").otherwise("PASS").alias("check_result"),
        F.lit(1000).alias("records_checked"),
        F.floor(F.col("value") * 10).alias("records_failed"),
        F.col("value").alias("failure_rate"),
        F.lit(50).alias("threshold"),
        F.col("props").alias("check_details"),
        at.alias("checked_at"),
        F.to_date("ts").alias("processing_date"),
        at.alias("created_at"),
    )
    return _conform(df, DATA_QUALITY_CHECKS)


def data_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("freshness_id"),
        F.concat(F.lit("bronze.t"), (F.col("user_id") % 10).cast("string")).alias("table_name"),
        F.lit("bronze").alias("layer_name"),
        F.to_date("ts").alias("latest_data_date"),
        at.alias("latest_ingestion_time"),
        at.alias("current_check_time"),
        F.col("value").alias("data_latency_hours"),
        (F.col("value") <= 24).alias("is_fresh"),
        F.lit(24).alias("freshness_sla_hours"),
        F.col("event_id").alias("record_count"),
        F.to_date(F.lit("2024-01-01")).alias("min_date"),
        F.to_date("ts").alias("max_date"),
        at.alias("checked_at"),
        at.alias("created_at"),
    )
    return _conform(df, DATA_FRESHNESS)
