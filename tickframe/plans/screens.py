"""Screeners and dashboards over the gold tables.

A screen runs for the newest day of its table, for one given day, or, with
``EACH_DAY``, for every day at once with the limit applied per day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.windows import top_per_group

LATEST, EACH_DAY = "latest", "each_day"

# Partition column of tables laid out by month of their date.
MONTH = "month"
KEY = "ticker_standard"


def latest_slice(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows of the newest day; the maximum is a scalar subquery of the same job.

    In a table laid out by month, only the newest month is read.
    """
    if MONTH in df.columns:
        df = df.where(F.col(MONTH) == df.agg(F.max(MONTH)).scalar())
    return df.where(F.col(date_col) == df.agg(F.max(date_col)).scalar())


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != MONTH]


def on_day(df: DataFrame, when: str | date, date_col: str = "date") -> DataFrame:
    if when == LATEST:
        return latest_slice(df, date_col)
    if when == EACH_DAY:
        return df
    if MONTH in df.columns:
        df = df.where(F.col(MONTH) == F.trunc(F.lit(when), "MM"))
    return df.where(F.col(date_col) == F.lit(when))


def screen(
    df: DataFrame, when: str | date, condition: Column | None, order: Sequence[Column],
    k: int | None, columns: Sequence[str],
) -> DataFrame:
    """Filter, order by ``order`` with ties broken by ticker, keep the first ``k``."""
    hits = on_day(df, when)
    if condition is not None:
        hits = hits.where(condition)
    if when == EACH_DAY:
        columns = [c for c in columns if c != "date"]
        if k is not None:
            hits = top_per_group(hits, ["date"], order, k, "_rank")
        return hits.select("date", *columns)
    hits = hits.orderBy(*order)
    return (hits.limit(k) if k is not None else hits).select(*columns)


def _best(c: str) -> list[Column]:
    return [F.col(c).desc_nulls_last(), F.asc(KEY)]


def _all_positive(*columns: str) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & (F.col(c) > 0)
    return condition


def _steady() -> Column:
    return _all_positive("return_7d_pct", "return_30d_pct", "return_90d_pct") & (F.col("consistency_score_30d") > 60)


def momentum(multitime: DataFrame, when=LATEST, k: int = 10) -> DataFrame:
    return screen(multitime, when, _steady(), _best("return_30d_pct"), k, [
        "ticker_standard", "sector", "close", "return_7d_pct", "return_30d_pct", "return_90d_pct",
        "return_180d_pct", "consistency_score_30d", "volatility_30d", "max_drawdown_30d_pct",
    ])


def consistent_uptrend(multitime: DataFrame, when=LATEST) -> DataFrame:
    return screen(multitime, when, _steady(), _best("return_30d_pct"), None, [
        "ticker_standard", "return_30d_pct", "consistency_score_30d", "volatility_30d",
    ])


def top_performers_30d(multitime: DataFrame, when=LATEST, k: int = 5) -> DataFrame:
    return screen(multitime, when, None, _best("return_30d_pct"), k, data_columns(multitime))


def sector_leaders(strength: DataFrame, when=LATEST, k: int = 10) -> DataFrame:
    leads = (F.col("relative_strength_label") == "Sector Leader") & (F.col("percentile_in_sector") >= 80)
    return screen(strength, when, leads, _best("outperformance_vs_sector_pct"), k, [
        "ticker_standard", "sector", "close", "daily_return_pct", "sector_return_pct", "market_return_pct",
        "outperformance_vs_sector_pct", "outperformance_vs_market_pct", "percentile_in_sector",
        "relative_strength_label",
    ])


def leaders_by_outperformance(strength: DataFrame, when=LATEST, k: int = 5) -> DataFrame:
    leads = F.col("relative_strength_label") == "Sector Leader"
    return screen(strength, when, leads, _best("outperformance_vs_sector_pct"), k, data_columns(strength))


def top_per_sector(strength: DataFrame, when=LATEST, k: int = 3) -> DataFrame:
    """Strongest stocks of each sector on the chosen day or days."""
    ranked = top_per_group(
        on_day(strength, when), ["date", "sector"], _best("percentile_in_sector"), k, "rn"
    )
    lead = ["date"] if when == EACH_DAY else []
    return ranked.orderBy(*lead, "sector", "rn").select(
        *lead, "sector", "ticker_standard", "percentile_in_sector", "relative_strength_label"
    )


def breakout_candidates(technical: DataFrame, when=LATEST, k: int = 10) -> DataFrame:
    hit = F.col("breakout_30d_high_flag") & F.col("volume_breakout_flag") & (F.col("distance_from_52w_high_pct") > -10)
    return screen(technical, when, hit, _best("volume_ratio"), k, [
        "ticker_standard", "sector", "close", "distance_from_52w_high_pct", "high_30d", "volume",
        "avg_volume_20d", "volume_ratio", "bb_position", "breakout_30d_high_flag", "volume_breakout_flag",
        "strong_bullish_signal",
    ])


def at_year_high(technical: DataFrame, when=LATEST, k: int = 5) -> DataFrame:
    hit = F.col("at_52w_high_flag") & F.col("volume_breakout_flag")
    return screen(technical, when, hit, _best("volume_ratio"), k, data_columns(technical))


def near_year_high(technical: DataFrame, when=LATEST) -> DataFrame:
    hit = (F.col("distance_from_52w_high_pct") > -5) & (F.col("volume_ratio") > 1.2)
    return screen(technical, when, hit, _best("distance_from_52w_high_pct"), None, [
        "ticker_standard", "close", "distance_from_52w_high_pct", "volume_ratio",
    ])


def bullish_alignment(daily: DataFrame, when=LATEST, k: int = 10) -> DataFrame:
    hit = (F.col("trend_signal") == "Bullish") & (F.col("price_vs_ma20_pct") > 0)
    return screen(daily, when, hit, _best("daily_return_pct"), k, [
        "ticker_standard", "sector", "date", "close", "ma_20", "ma_50", "ma_200", "daily_return_pct",
        "trend_signal", "price_vs_ma20_pct",
    ])


def portfolio_dashboard(daily: DataFrame, when=LATEST) -> DataFrame:
    return screen(daily, when, None, [F.asc(KEY)], None, [
        "ticker_standard", "close", "ma_20", "ma_50", "ma_200", "trend_signal",
    ])


def recent_for_ticker(daily: DataFrame, ticker: str, k: int = 5) -> DataFrame:
    """Newest rows of one ticker in a gold table."""
    return daily.where(F.col("ticker_standard") == ticker).orderBy(F.desc("date")).limit(k).select(*data_columns(daily))


def sector_performance(sector_daily: DataFrame, when=LATEST) -> DataFrame:
    order = [F.col("avg_daily_return_pct").desc_nulls_last(), F.col("sector").asc()]
    return screen(sector_daily, when, None, order, None, [
        "sector", "stock_count", "avg_daily_return_pct", "return_volatility", "total_volume",
        "gainers_count", "losers_count", "sector_sentiment",
    ])


def sector_heatmap(sector_daily: DataFrame, when=LATEST) -> DataFrame:
    return screen(sector_daily, when, None, [F.col("sector").asc()], None, [
        "sector", "avg_daily_return_pct", "return_volatility",
    ])


def movers(top_movers: DataFrame, when=LATEST, k: int = 5) -> DataFrame:
    order = [F.col("mover_type").desc(), F.col("rank_position").asc()]
    return screen(top_movers, when, F.col("rank_position") <= k, order, None, [
        "mover_type", "rank_position", "ticker_standard", "sector", "close", "daily_return_pct", "volume",
        "volume_vs_avg_pct",
    ])


def gainers_alert(top_movers: DataFrame, when=LATEST) -> DataFrame:
    hit = F.col("mover_type") == "Gainer"
    return screen(top_movers, when, hit, [F.col("rank_position").asc()], None, ["ticker_standard", "daily_return_pct"])


def market_recent(overview: DataFrame, days: int = 7) -> DataFrame:
    return overview.orderBy(F.desc("date")).limit(days).select(
        "date", "total_stocks", "market_avg_return_pct", "market_volatility", "advancing_stocks",
        "declining_stocks", "advance_decline_ratio", "market_sentiment", "total_market_volume",
        "above_ma200_count",
    )


def market_scorecard(overview: DataFrame) -> DataFrame:
    return overview.orderBy(F.desc("date")).limit(1).select(
        "market_avg_return_pct", "advance_decline_ratio", "market_sentiment"
    )


def recent_bars(silver: DataFrame, ticker: str, as_of: date, days: int = 30, k: int = 20) -> DataFrame:
    since = as_of - timedelta(days=days)
    return (
        silver.where((F.col("ticker_standard") == ticker) & (F.col("date") >= F.lit(since)))
        .orderBy(F.desc("date"))
        .limit(k)
        .select(
            "ticker_standard", "date", "open", "high", "low", "close", "volume", "daily_return_pct",
            "price_range", "is_trading_day",
        )
    )
