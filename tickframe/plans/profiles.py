"""Counts and spans of the tables, and reports over the dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions import distinct
from tickframe.functions.numeric import COUNT, count_where, mean
from tickframe.operators.dimensions import mapped_only


def _span():
    return [F.count(F.lit(1)).alias("record_count"), F.min("date").alias("earliest_date"), F.max("date").alias("latest_date")]


def per_ticker(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(*_span()).orderBy("ticker")


def per_ticker_with_means(silver: DataFrame, k: int | None = 20) -> DataFrame:
    out = (
        silver.groupBy("ticker")
        .agg(*_span(), mean("close").alias("avg_close_price"), mean("volume", dtype=COUNT).alias("avg_volume"))
        .orderBy("ticker")
    )
    return out if k is None else out.limit(k)


def source_profile(bars: DataFrame, label: str) -> DataFrame:
    return bars.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("ticker").alias("unique_tickers"),
        F.min("date").alias("earliest_date"),
        F.max("date").alias("latest_date"),
    ).select(F.lit(label).alias("source"), "*")


def period_profiles(bars: DataFrame, tickers: DataFrame, period: str = "ingestion_date") -> DataFrame:
    """Rows, span and the bitmap of tickers of every landing period: what a later profile needs of it.

    ``tickers`` is the dictionary of the ticker column. A row holds one word of the bitmap; rows and span stand beside
    each, so take them once a period.
    """
    bitmaps = distinct.words(bars.join(tickers, "ticker"), [period], F.col("code"))
    return bars.groupBy(period).agg(*_span()).join(bitmaps, period, "left")


def merged_profile(profiles: DataFrame, label: str, period: str = "ingestion_date") -> DataFrame:
    """``source_profile`` of all periods together, from their profiles alone."""
    spans = profiles.groupBy(period).agg(*[F.first(c).alias(c) for c in ("record_count", "earliest_date", "latest_date")])
    whole = spans.agg(F.sum("record_count").alias("total_records"), F.min("earliest_date").alias("earliest_date"), F.max("latest_date").alias("latest_date"))
    unique = distinct.counts(distinct.merged([profiles.where("word IS NOT NULL").select("word", "bits")], []), [], "unique_tickers")
    # One row each.
    n = unique.select(F.coalesce("unique_tickers", F.lit(0).cast("long"))).scalar()
    return whole.select(F.lit(label).alias("source"), "total_records", n.alias("unique_tickers"), "earliest_date", "latest_date")


def stream_vs_batch(streamed: DataFrame, batch: DataFrame) -> DataFrame:
    return source_profile(streamed, "Streaming Table").unionByName(source_profile(batch, "Batch Table"))


def layer_counts(bars: DataFrame, layer: str) -> DataFrame:
    """Rows, tickers and dates; each task sends on only the distinct values it saw."""
    return bars.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("ticker").alias("unique_tickers"),
        F.countDistinct("date").alias("unique_dates"),
    ).select(F.lit(layer).alias("layer"), "*")


def bronze_vs_silver(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    return layer_counts(bronze, "Bronze").unionByName(layer_counts(silver, "Silver"))


def _by_count(name: str):
    return [F.desc(name), F.asc("sector")]


def active_by_sector(config: DataFrame) -> DataFrame:
    return (
        config.where("is_active").groupBy("sector").agg(F.count(F.lit(1)).alias("ticker_count"))
        .orderBy(*_by_count("ticker_count"))
    )


def tickers_of_sector(config: DataFrame, sector: str) -> DataFrame:
    return config.where((F.col("sector") == sector) & F.col("is_active")).select("ticker_symbol", "company_name")


def count_and_active_by_sector(config: DataFrame) -> DataFrame:
    return (
        config.groupBy("sector")
        .agg(F.count(F.lit(1)).alias("count"), count_where(F.col("is_active")).alias("active_count"))
        .orderBy(*_by_count("count"))
    )


def mapped_by_sector(sectors: DataFrame) -> DataFrame:
    return sectors.groupBy("sector").agg(F.count(F.lit(1)).alias("ticker_count")).orderBy(*_by_count("ticker_count"))


def mapped_total(sectors: DataFrame) -> DataFrame:
    return sectors.agg(F.count(F.lit(1)).alias("total_tickers_mapped"))


def sector_analytics(silver: DataFrame, sectors: DataFrame) -> DataFrame:
    """Stocks and mean return per day and sector.

    Silver holds a ticker once a day, so counting bars counts the distinct
    tickers without sending every one of them through the shuffle.
    """
    return (
        mapped_only(silver, sectors)
        .groupBy("date", "sector")
        .agg(F.count("ticker_standard").alias("stock_count"), mean("daily_return_pct").alias("avg_return"))
        .orderBy(F.desc("date"), F.desc_nulls_last("avg_return"), F.asc("sector"))
    )
