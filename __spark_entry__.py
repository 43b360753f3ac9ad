
from __future__ import annotations

import importlib.util
import os
import sys
import uuid
from collections.abc import Callable
from datetime import date, datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from oracle.catalog import STATEMENTS  # noqa: E402
from tickframe.functions import distinct  # noqa: E402
from tickframe.operators import clean, dimensions, quality, upsert  # noqa: E402
from tickframe.plans import gold, monitor, profiles, screens  # noqa: E402
from tickframe.plans.lakehouse import BRONZE, Lakehouse, quarantined_bars, refresh_silver, shared_folder, silver_bars  # noqa: E402
from tickframe.schemas import BAR_COLUMNS, TICKER_CONFIG, create_tables  # noqa: E402
from tickframe.sinks import append_audit, append_bars, export_daily_json, write_bucketed  # noqa: E402
from tickframe.sources import bars, testdata  # noqa: E402
from tickframe.staging import stored  # noqa: E402
from tickframe.streaming import ingest  # noqa: E402

# The text operators are an optional subpackage: without it, all other queries stay as they are.
_package = importlib.util.find_spec("tickframe.llm")
if _package and _package.origin and importlib.util.find_spec("corpus_pipeline"):
    from tickframe.llm.catalog import ORACLE_SQL as TEXT_STATEMENTS
    from tickframe.llm.catalog import QUERIES as TEXT_QUERIES

    import corpus_pipeline

    TEXT_QUERIES = {**TEXT_QUERIES, "pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        TEXT_STATEMENTS = {**TEXT_STATEMENTS, "pipeline": corpus_pipeline.ORACLE_SQL}
else:
    TEXT_QUERIES, TEXT_STATEMENTS = {}, {}

Query = Callable[[SparkSession, str], DataFrame]

RULES = quality.bar_rules
AS_OF = datetime(2001, 11, 5)
MONITOR_DAY = date(2001, 8, 1)
CHECKS_DAY = date(2024, 1, 31)
LATE_MONTH = date(1999, 3, 1)
# Bars that a bucket of silver holds about.
BUCKET_ROWS = 1_000_000
# Days on which the strictest screens find something at every size.
RISING_DAY, BREAKOUT_DAY = date(1999, 12, 24), date(2001, 7, 8)

_lakes: dict[tuple[str, str], Lakehouse] = {}


def lake(spark: SparkSession, sf_dir: str) -> Lakehouse:
    """The tables derived from ``sf_dir``, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        _lakes[key] = Lakehouse(spark, testdata.raw_bars(spark, sf_dir), testdata.sector_map(spark, sf_dir))
    return _lakes[key]


def _raw(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(testdata.raw_bars(spark, sf_dir))


def _bronze(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(lake(spark, sf_dir).bronze)


def _typed(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _bronze(lambda df: build(clean.clean(df)))


def _silver(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(lake(spark, sf_dir).silver)


def _mapped(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(lake(spark, sf_dir).silver, lake(spark, sf_dir).sectors)


def _config(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(testdata.ticker_config(spark, sf_dir))


def _gold_plan(name: str) -> Query:
    return lambda spark, sf_dir: lake(spark, sf_dir).plan(name)


def _gold(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(lake(spark, sf_dir).gold(name))


def _audit(adapter: Callable[[SparkSession, str], DataFrame], build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(adapter(spark, sf_dir))


def _screens(name: str, table: str, build: Callable[..., DataFrame], when=screens.LATEST) -> dict[str, Query]:
    """A screen for the newest day, or one on which it finds something, and the same screen for every day."""
    return {
        name: _gold(table, lambda df: build(df, when)),
        f"{name}_daily": _gold(table, lambda df: build(df, screens.EACH_DAY)),
    }


def _reasons_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("failure_reasons", F.array_join("failure_reasons", ","))


def _vendor_shape(df: DataFrame) -> DataFrame:
    """Bars under the vendor's column titles, with columns bronze does not keep."""
    titles = {ours: vendor for vendor, ours in bars.VENDOR_COLUMNS.items()}
    return df.drop("ingestion_timestamp", "source", "ingestion_date").withColumnsRenamed(titles)


def _upsert_pair(silver: DataFrame) -> tuple[DataFrame, DataFrame]:
    target = silver.where(F.col("date") < "2000-01-01")
    source = silver.where(F.col("date") >= "1999-07-01").withColumn("volume", F.col("volume") + 1)
    return target, source


def _upserted(silver: DataFrame) -> DataFrame:
    target, source = _upsert_pair(silver)
    return upsert.upsert(target, source, clean.KEYS).select("ticker", "date", "close", "volume", "record_id")


def _upserted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert on a written table: only touched months are rewritten."""
    month = F.trunc("date", "MM")
    target, source = (df.withColumn("month", month) for df in _upsert_pair(lake(spark, sf_dir).silver))
    root = shared_folder(spark)
    for rows in (target, source):
        upsert.upsert_table(spark, f"{root}/target", rows, clean.KEYS, "month", f"{root}/staging")
    return spark.read.parquet(f"{root}/target").select("ticker", "date", "close", "volume", "record_id")


def _maintained(config: DataFrame) -> DataFrame:
    at = datetime(2024, 6, 1)
    new = [(0, "NEWCO.NS", "NEWCO", "Co NEWCO", "AFRICA", True, at.date(), at)]
    rows = config.sparkSession.createDataFrame(new, TICKER_CONFIG)
    return dimensions.add_tickers(dimensions.deactivate(config, "SUP3.NS", at), rows)


def _once(build: Callable[[SparkSession, str], str]) -> Callable[[SparkSession, str], str]:
    """A folder that several queries read, made once per application."""
    made: dict[tuple[str, str], str] = {}

    def get(spark: SparkSession, sf_dir: str) -> str:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = build(spark, sf_dir)
        return made[key]

    return get


@_once
def landing(spark: SparkSession, sf_dir: str) -> str:
    """All bars as daily JSON drops."""
    folder = f"{shared_folder(spark)}/landing"
    export_daily_json(testdata.raw_bars(spark, sf_dir).select(*BAR_COLUMNS), folder)
    return folder


@_once
def _stream_table(spark: SparkSession, sf_dir: str) -> str:
    """All daily drops, ingested by the file stream."""
    root = shared_folder(spark)
    ingest.ingest_available(spark, landing(spark, sf_dir), f"{root}/bronze", f"{root}/checkpoint")
    return f"{root}/bronze"


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_stream_table(spark, sf_dir))


def _stream_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of two runs of the stream, an export each."""
    root, rows = shared_folder(spark), lake(spark, sf_dir).bronze.select(*BAR_COLUMNS)
    audit, early = f"{root}/metrics", F.col("date") < "2000-01-01"
    for run_id, part in (("run-1", rows.where(early)), ("run-2", rows.where(~early))):
        export_daily_json(part, f"{root}/landing", "ingestion_date")
        done = ingest.ingest_available(spark, f"{root}/landing", f"{root}/bronze", f"{root}/checkpoint")
        append_audit(monitor.ingest_profile(spark, done, run_id=run_id, layer="bronze", table="bronze.stock_prices_stream"), audit)
    return spark.read.parquet(audit).select(
        "metric_id", "run_id", "layer_name", "table_name", "operation", "rows_read", "rows_written", (F.col("bytes_written") > 0).alias("has_bytes"), "status"
    )


def _stream_unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with lines that are cut off, and with a column more from the second export on: bars, then the quarantined lines."""
    root, rows = shared_folder(spark), lake(spark, sf_dir).bronze.select(*BAR_COLUMNS)
    early = F.col("date") < "2000-01-01"
    cut_off = F.concat(F.lit('{"ticker": "'), "ticker", F.lit('", "volume": '), F.col("volume").cast("string"))
    wider = rows.where(~early).withColumn("turnover", F.round(F.col("close") * F.col("volume"), 2))
    for part in (rows.where(early), wider):
        export_daily_json(part, f"{root}/landing", "ingestion_date")
        rows.where("volume % 700 = 0").select(cut_off.alias("value")).write.mode("append").text(f"{root}/landing/broken")
        schema = ingest.grown_schema(spark, f"{root}/landing", f"{root}/schemas")
        ingest.ingest_available(
            spark, f"{root}/landing", f"{root}/bronze", f"{root}/checkpoint", schema=schema, quarantine=f"{root}/bad"
        )
    good = spark.read.option("mergeSchema", "true").parquet(f"{root}/bronze").select("ticker", "date", "close", "turnover")
    bad = spark.read.parquet(f"{root}/bad").select(F.col(ingest.CORRUPT).alias("line"))
    return good.unionByName(bad, allowMissingColumns=True)


def _created_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared audit tables, created and filled with the runs and metrics; run summaries read from them."""
    database = f"audit_{uuid.uuid4().hex}"
    create_tables(spark, database)
    for name, rows in (("pipeline_runs", testdata.pipeline_runs), ("layer_metrics", testdata.layer_metrics)):
        target = spark.table(f"{database}.{name}")
        # By year: a folder each, and not one a day.
        filled = rows(spark, sf_dir).withColumn("processing_date", F.trunc("processing_date", "YYYY")).select(*target.columns)
        filled.hint("rebalance", "processing_date").write.insertInto(f"{database}.{name}")
    runs, metrics = spark.table(f"{database}.pipeline_runs"), spark.table(f"{database}.layer_metrics")
    return (
        runs.groupBy("processing_date").agg(F.count("*").alias("runs"))
        .join(metrics.groupBy("processing_date").agg(F.count("*").alias("metrics"), F.sum("rows_written").alias("rows_written")), "processing_date", "full")
    )


def _profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of bronze from stored profiles of its landing periods, the later ones taken and added apart."""
    rows, late = lake(spark, sf_dir).bronze, F.col("ingestion_date") >= "1999-01-01"
    path, tickers = f"{shared_folder(spark)}/profiles", None
    for part in (rows.where(~late), rows.where(late)):
        tickers = stored(distinct.dictionary(part, "ticker", stored, tickers))
        profiles.period_profiles(part, tickers).write.mode("append").parquet(path)
    return profiles.merged_profile(spark.read.parquet(path), "Bronze")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze in two appends by landing day, read back."""
    path, rows = f"{shared_folder(spark)}/bars", testdata.raw_bars(spark, sf_dir)
    append_bars(rows.where(F.col("ingestion_date") < "1999-01-01"), path)
    append_bars(rows.where(F.col("ingestion_date") >= "1999-01-01"), path)
    return spark.read.schema(rows.schema).parquet(path)


def _quarantined_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine table after the same refresh has run twice."""
    root = shared_folder(spark)
    for _ in range(2):
        refresh_silver(spark, lake(spark, sf_dir).bronze, f"{root}/silver", f"{root}/staging", f"{root}/bad", at=AS_OF)
    return _reasons_as_text(spark.read.parquet(f"{root}/bad"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries from audit rows appended in two writes."""
    path, rows = f"{shared_folder(spark)}/metrics", testdata.layer_metrics(spark, sf_dir)
    append_audit(rows.where("status = 'SUCCESS'"), path)
    append_audit(rows.where("status <> 'SUCCESS'"), path)
    return monitor.run_summary(
        spark.read.parquet(path), run_name="daily", run_type="INCREMENTAL", triggered_by="scheduler"
    )


def _upserted_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts, the second with a column more."""
    silver = lake(spark, sf_dir).silver.select("ticker_standard", "date", "close", F.trunc("date", "MM").alias("month"))
    root = shared_folder(spark)
    early, late = F.col("date") < "1999-01-01", F.col("date") >= "1998-06-01"
    for rows in (silver.where(early), silver.where(late).withColumn("note", F.lit("late")), silver.where(F.col("date") >= "2001-01-01")):
        upsert.upsert_table(spark, f"{root}/t", rows, clean.KEYS, "month", f"{root}/staging")
    return upsert.read_if_exists(spark, f"{root}/t").select("ticker_standard", "date", "close", "note")


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics over silver in hash buckets: no exchange between the scan and the result.

    Silver goes into its buckets as it is made, and their number follows from the bars, so that a task can sort one.
    """
    tables, name = lake(spark, sf_dir), f"silver_{uuid.uuid4().hex}"
    bronze = tables.bronze
    buckets = max(8, tables.rows[BRONZE] // BUCKET_ROWS)
    silver = write_bucketed(silver_bars(bronze, buckets=buckets), name, f"{shared_folder(spark)}/{name}", *clean.KEYS, buckets=buckets, dealt=True)
    return gold.stock_daily_metrics(silver, tables.sectors)


def _refreshed(spark: SparkSession, sf_dir: str, name: str) -> Lakehouse:
    """A lake with the gold table ``name``, built without the bars of one month, then refreshed with them."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} refreshed {name}")
    if key not in _lakes:
        rows, late = testdata.raw_bars(spark, sf_dir), F.col("ingestion_date") == F.lit(LATE_MONTH)
        tables = Lakehouse(spark, rows.where(~late), testdata.sector_map(spark, sf_dir), by_month=True, only=[name])
        tables.refresh(rows.where(late), [name])
        _lakes[key] = tables
    return _lakes[key]


def _refreshed_gold(name: str) -> Query:
    return lambda spark, sf_dir: _refreshed(spark, sf_dir, name).gold(name).drop("month")


def _walk(part: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = lake(spark, sf_dir)
        return monitor.monitored_walk(
            tables.bronze, tables.silver, tables.gold("stock_daily_metrics"), run_id="run-1", as_of=AS_OF
        )[part]

    return run


def _bronze_check(check: Callable[..., DataFrame], *args) -> Query:
    return _bronze(lambda df: check(df, *args, run_id="run-1", layer="bronze", table="bronze.stock_prices_raw", as_of=AS_OF))


DAILY, SECTOR, MOVERS, OVERVIEW = "stock_daily_metrics", "sector_daily_metrics", "top_movers_daily", "market_overview_daily"
MULTITIME, STRENGTH, TECHNICAL = "stock_multitime_performance", "stock_relative_strength", "stock_technical_levels"


def entry(spark: SparkSession) -> DataFrame:
    """Daily metrics of every stock, from raw bars to moving averages."""
    return lake(spark, "/root/testdata/sf0.001").plan(DAILY)


def queries() -> dict[str, Query]:
    return {
        # sources
        "bars_raw": _raw(lambda df: df),
        "bars_normalised": lambda spark, sf_dir: bars.normalise_bars(_vendor_shape(testdata.nation_bars(spark, sf_dir)), "vendor", AS_OF),
        "ingest_date_range": _bronze(lambda df: bars.in_range(df, *bars.backfill_range(MONITOR_DAY))),
        "universe_active": _config(bars.universe),
        "bars_of_universe": lambda spark, sf_dir: bars.restrict_to_universe(
            lake(spark, sf_dir).landed, testdata.ticker_config(spark, sf_dir)
        ).drop(bars.BUCKET),
        "daily_json_roundtrip": lambda spark, sf_dir: bars.read_json_bars(spark, landing(spark, sf_dir)),
        "stream_ingest": lambda spark, sf_dir: _streamed(spark, sf_dir).select(*BAR_COLUMNS),
        "stream_vs_batch": lambda spark, sf_dir: profiles.stream_vs_batch(
            _streamed(spark, sf_dir), lake(spark, sf_dir).bronze
        ),
        "stream_audit": _stream_audited,
        "stream_unexpected": _stream_unexpected,
        "tables_created": _created_tables,
        # silver
        "clean_typed": _typed(lambda df: df),
        "quality_flags": _typed(lambda df: _reasons_as_text(quality.RuleSet(RULES()).flag(df))),
        "quality_valid": _typed(lambda df: quality.RuleSet(RULES()).valid(df)),
        "quality_quarantine": _bronze(lambda df: _reasons_as_text(quarantined_bars(df, AS_OF))),
        "quality_rule_counts": _typed(lambda df: quality.RuleSet(RULES()).summary(df)),
        "duplicate_keys": _typed(lambda df: clean.duplicate_keys(quality.RuleSet(RULES()).valid(df))),
        "dedup_latest": _bronze(silver_bars),
        "gap_report": lambda spark, sf_dir: clean.gap_report(
            lake(spark, sf_dir).silver
        ),
        "upsert_silver": _silver(_upserted),
        "upsert_silver_table": _upserted_table,
        "upsert_growing_schema": _upserted_growing,
        "bars_appended": _appended,
        "quarantine_repeated": _quarantined_twice,
        "audit_appended": _audited,
        # dimensions
        "dimension_maintain": _config(_maintained),
        "sector_map_bootstrap": _config(dimensions.sector_map_from_config),
        "unmapped_tickers": _mapped(dimensions.unmapped_keys),
        "sector_join": _mapped(
            lambda s, m: dimensions.with_sector(s, m).select("ticker_standard", "sector", "date", "close", "volume")
        ),
        "sector_join_inner": _mapped(profiles.sector_analytics),
        # gold
        **{name: _gold_plan(name) for name in (DAILY, SECTOR, MOVERS, OVERVIEW, MULTITIME, STRENGTH, TECHNICAL)},
        **{f"{name}_refreshed": _refreshed_gold(name) for name in (DAILY, SECTOR, MOVERS, OVERVIEW, MULTITIME, STRENGTH, TECHNICAL)},
        "stock_daily_metrics_bucketed": _bucketed,
        "sector_daily_reduced": _gold(SECTOR, gold.sector_daily_reduced),
        "gainers_reduced": _gold(MOVERS, gold.gainers_reduced),
        # screens
        **_screens("screen_momentum", MULTITIME, screens.momentum, RISING_DAY),
        **_screens("screen_consistent_uptrend", MULTITIME, screens.consistent_uptrend, RISING_DAY),
        **_screens("screen_top_performers_30d", MULTITIME, screens.top_performers_30d),
        **_screens("screen_sector_leaders", STRENGTH, screens.sector_leaders),
        **_screens("screen_leaders_by_outperformance", STRENGTH, screens.leaders_by_outperformance),
        **_screens("screen_top_per_sector", STRENGTH, screens.top_per_sector),
        **_screens("screen_breakouts", TECHNICAL, screens.breakout_candidates, BREAKOUT_DAY),
        **_screens("screen_at_year_high", TECHNICAL, screens.at_year_high),
        **_screens("screen_near_year_high", TECHNICAL, screens.near_year_high),
        **_screens("screen_bullish_alignment", DAILY, screens.bullish_alignment),
        **_screens("screen_portfolio", DAILY, screens.portfolio_dashboard),
        **_screens("screen_sector_performance", SECTOR, screens.sector_performance),
        **_screens("screen_sector_heatmap", SECTOR, screens.sector_heatmap),
        **_screens("screen_movers", MOVERS, screens.movers),
        **_screens("screen_gainers_alert", MOVERS, screens.gainers_alert),
        "screen_recent_for_ticker": _gold(DAILY, lambda df: screens.recent_for_ticker(df, "SUP3")),
        "screen_market_recent": _gold(OVERVIEW, screens.market_recent),
        "screen_market_scorecard": _gold(OVERVIEW, screens.market_scorecard),
        "screen_recent_bars": _silver(lambda df: screens.recent_bars(df, "SUP3", MONITOR_DAY)),
        # profiles
        "profile_bronze_per_ticker": _bronze(profiles.per_ticker),
        "profile_silver_per_ticker": _silver(profiles.per_ticker_with_means),
        "profile_merged": _profile_merged,
        "profile_bronze_vs_silver": lambda spark, sf_dir: profiles.bronze_vs_silver(
            lake(spark, sf_dir).bronze, lake(spark, sf_dir).silver
        ),
        "config_active_by_sector": _config(profiles.active_by_sector),
        "config_tickers_of_sector": _config(lambda df: profiles.tickers_of_sector(df, "ASIA")),
        "config_count_and_active": _config(profiles.count_and_active_by_sector),
        "mapping_by_sector": _audit(testdata.sector_map, profiles.mapped_by_sector),
        "mapping_total": _audit(testdata.sector_map, profiles.mapped_total),
        # monitoring
        "null_check": _bronze_check(quality.null_check, ["ticker", "date", "open", "close"], 0.05),
        "duplicate_check": _bronze_check(quality.duplicate_check, ["ticker", "date"], 0.01),
        "freshness_check": _bronze(
            lambda df: quality.freshness_check(df, layer="bronze", table="bronze.stock_prices_raw", as_of=AS_OF)
        ),
        "layer_profile": lambda spark, sf_dir: monitor.layer_profile(
            lake(spark, sf_dir).silver, run_id="run-1", layer="silver", table="silver.stock_prices_clean",
            start=AS_OF, end=AS_OF, rows_read=lake(spark, sf_dir).bronze, operation="MERGE",
        ),
        "run_summary": _audit(
            testdata.layer_metrics,
            lambda df: monitor.run_summary(df, run_name="daily", run_type="INCREMENTAL", triggered_by="scheduler"),
        ),
        "monitored_walk_metrics": _walk("metrics"),
        "monitored_walk_checks": _walk("checks"),
        "monitored_walk_freshness": _walk("freshness"),
        "monitor_recent_runs": _audit(testdata.pipeline_runs, monitor.recent_runs),
        "monitor_success_rate": _audit(testdata.pipeline_runs, lambda df: monitor.success_rate(df, MONITOR_DAY)),
        "monitor_layer_performance": _audit(testdata.layer_metrics, lambda df: monitor.layer_performance(df, MONITOR_DAY)),
        "monitor_quality_issues": _audit(testdata.data_quality_checks, lambda df: monitor.quality_issues(df, CHECKS_DAY)),
        "monitor_freshness": _audit(testdata.data_freshness, monitor.current_freshness),
        "monitor_bottlenecks": _audit(testdata.layer_metrics, lambda df: monitor.bottlenecks(df, MONITOR_DAY)),
        **TEXT_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**STATEMENTS, **TEXT_STATEMENTS}
