"""The seven gold tables, each one plan over the silver table.

``block_rows`` splits long series for the rolling windows; see
``functions.windows``. None means each ticker's series fits one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.numeric import COUNT, RETURN, count_where, difference, mean, mean_count, pct_over, ratio
from tickframe.functions.windows import Series, over_series, top_per_group
from tickframe.operators.dimensions import with_sector
from tickframe.operators.numbering import numbered
from tickframe.staging import stored

KEY, DATE = "ticker_standard", "date"

# Horizons in rows and the thresholds of the derived labels.
MA_ROWS = (20, 50, 200)
RETURN_ROWS = (7, 30, 90, 180)
VOLATILITY_ROWS = (7, 30, 90)
YEAR_ROWS, MONTH_ROWS, BAND_ROWS = 252, 30, 20
SENTIMENT_PCT = 1
BREADTH_FACTOR = 1.5
VOLUME_BREAKOUT = 1.5
NEAR_HIGH, NEAR_LOW = 0.98, 1.02
STRONG_MOVE_PCT = 2
TOP_MOVERS = 10

DAILY_COLUMNS = [
    KEY, "sector", DATE, "open", "high", "low", "close", "volume", "daily_return_pct", "price_range",
    "ma_20", "ma_50", "ma_200", "price_vs_ma20_pct", "price_vs_ma50_pct", "price_vs_ma200_pct",
    "trend_signal", "ma_20_volume", "volume_vs_avg_pct",
]
MULTITIME_COLUMNS = [
    KEY, "sector", DATE, "close", "return_7d_pct", "return_30d_pct", "return_90d_pct", "return_180d_pct",
    "volatility_7d", "volatility_30d", "volatility_90d", "consistency_score_30d", "max_drawdown_30d_pct",
]
TECHNICAL_COLUMNS = [
    KEY, "sector", DATE, "close", "high_52w", "low_52w", "distance_from_52w_high_pct",
    "distance_from_52w_low_pct", "at_52w_high_flag", "at_52w_low_flag", "high_30d", "low_30d",
    "breakout_30d_high_flag", "breakdown_30d_low_flag", "volume", "avg_volume_20d", "volume_ratio",
    "volume_breakout_flag", "bb_upper", "bb_lower", "bb_position", "strong_bullish_signal",
    "strong_bearish_signal",
]


# What the tables by day and sector read of the daily metrics.
SECTOR_INPUT = [
    KEY, "sector", DATE, "close", "volume", "daily_return_pct", "price_vs_ma20_pct", "price_vs_ma50_pct", "trend_signal",
    "volume_vs_avg_pct",
]
MOVERS_INPUT = [KEY, "sector", DATE, "close", "volume", "daily_return_pct", "trend_signal", "volume_vs_avg_pct"]
OVERVIEW_INPUT = [
    KEY, "sector", DATE, "close", "volume", "daily_return_pct", "price_range", "ma_20", "ma_50", "ma_200", "trend_signal",
]


def _flag(condition: Column) -> Column:
    """True or false, an unknown condition being false."""
    return F.coalesce(condition, F.lit(False))


def stock_features(silver: DataFrame, sectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Every rolling measure of every stock, in one shuffle and one sort.

    The three per-stock tables are column choices of this one. Written once, it
    serves all three; planned for one of them, Catalyst drops the windows that
    table does not use.
    """
    bars = silver.select(KEY, DATE, "open", "high", "low", "close", "volume", "daily_return_pct", "price_range")
    close, ret = F.col("close"), F.col("daily_return_pct")

    def build(rows: DataFrame, s: Series) -> DataFrame:
        summed = s.placed(rows).withColumns(
            {
                **s.totals("close", "close"),
                **s.totals("volume", "volume", COUNT),
                **s.squares("price", "close"),
                **s.squares("return", "daily_return_pct"),
                "gains": F.sum(F.when(ret > 0, 1).otherwise(0)).over(s.running()),
                **{f"return_{n}d_pct": pct_over("close", s.lag("close", n)) for n in RETURN_ROWS},
            }
        ).withColumns(
            {
                **{f"ma_{n}": s.mean("close", n, 2) for n in MA_ROWS},
                "ma_20_volume": s.mean("volume", BAND_ROWS, 0).cast("long"),
                "stddev_20": F.round(s.deviation("price", BAND_ROWS), 2),
                **{f"volatility_{n}d": F.round(s.deviation("return", n), 2) for n in VOLATILITY_ROWS},
                "consistency_score_30d": F.round(s.rolled("gains", MONTH_ROWS) / 30.0 * 100, 1),
            }
        )
        return s.extremes(
            summed,
            {
                "high_30d": ("high", F.greatest, MONTH_ROWS),
                "low_30d": ("low", F.least, MONTH_ROWS),
                "high_52w": ("high", F.greatest, YEAR_ROWS),
                "low_52w": ("low", F.least, YEAR_ROWS),
            },
        )

    rolled = over_series(bars, KEY, DATE, YEAR_ROWS - 1, build, block_rows)
    short, middle, long = (F.col(f"ma_{n}") for n in MA_ROWS)
    measured = rolled.withColumns(
        {
            **{f"price_vs_ma{n}_pct": pct_over("close", f"ma_{n}") for n in MA_ROWS},
            "trend_signal": F.when((short > middle) & (middle > long), "Bullish")
            .when((short < middle) & (middle < long), "Bearish")
            .otherwise("Neutral"),
            "volume_vs_avg_pct": pct_over("volume", "ma_20_volume"),
            "max_drawdown_30d_pct": pct_over("close", "high_30d"),
            "distance_from_52w_high_pct": pct_over("close", "high_52w"),
            "distance_from_52w_low_pct": pct_over("close", "low_52w"),
            "at_52w_high_flag": _flag(close >= F.col("high_52w") * NEAR_HIGH),
            "at_52w_low_flag": _flag(close <= F.col("low_52w") * NEAR_LOW),
            "breakout_30d_high_flag": _flag(F.col("high") >= F.col("high_30d")),
            "breakdown_30d_low_flag": _flag(F.col("low") <= F.col("low_30d")),
            "avg_volume_20d": F.col("ma_20_volume"),
            "volume_ratio": F.round(ratio("volume", "ma_20_volume"), 2),
            "bb_upper": F.round(F.col("ma_20") + 2 * F.col("stddev_20"), 2),
            "bb_lower": F.round(F.col("ma_20") - 2 * F.col("stddev_20"), 2),
        }
    )
    breakout = _flag(F.col("volume_ratio") >= VOLUME_BREAKOUT)
    signals = measured.withColumns(
        {
            "volume_breakout_flag": breakout,
            "bb_position": F.when(close >= F.col("bb_upper"), "Above Upper Band")
            .when(close <= F.col("bb_lower"), "Below Lower Band")
            .otherwise("Within Bands"),
            "strong_bullish_signal": _flag((ret > STRONG_MOVE_PCT) & breakout),
            "strong_bearish_signal": _flag((ret < -STRONG_MOVE_PCT) & breakout),
        }
    )
    columns = dict.fromkeys(DAILY_COLUMNS + MULTITIME_COLUMNS + TECHNICAL_COLUMNS)
    return with_sector(signals, sectors).select(*columns)


def stock_daily_metrics(silver: DataFrame, sectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Moving averages, distance from them, trend and relative volume."""
    return stock_features(silver, sectors, block_rows).select(*DAILY_COLUMNS)


def stock_multitime_performance(silver: DataFrame, sectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Returns, volatility, consistency and draw-down over several horizons."""
    return stock_features(silver, sectors, block_rows).select(*MULTITIME_COLUMNS)


def stock_technical_levels(silver: DataFrame, sectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Extremes, breakouts, relative volume and Bollinger bands."""
    return stock_features(silver, sectors, block_rows).select(*TECHNICAL_COLUMNS)


def sector_daily_metrics(daily: DataFrame) -> DataFrame:
    """Sector averages, breadth and sentiment per day; unmapped tickers are left out."""
    trend, ret = F.col("trend_signal"), F.col("daily_return_pct")
    return (
        daily.where(F.col("sector").isNotNull())
        .groupBy("sector", DATE)
        .agg(
            F.count(KEY).alias("stock_count"),
            mean("close", 2).alias("avg_close_price"),
            mean(ret, 2).alias("avg_daily_return_pct"),
            F.round(F.stddev(ret), 2).alias("return_volatility"),
            mean("price_vs_ma20_pct", 2).alias("avg_price_vs_ma20_pct"),
            mean("price_vs_ma50_pct", 2).alias("avg_price_vs_ma50_pct"),
            F.sum("volume").alias("total_volume"),
            mean_count("volume").alias("avg_volume"),
            mean("volume_vs_avg_pct", 2).alias("avg_volume_vs_avg_pct"),
            count_where(trend == "Bullish").alias("bullish_count"),
            count_where(trend == "Bearish").alias("bearish_count"),
            count_where(trend == "Neutral").alias("neutral_count"),
            count_where(ret > 0).alias("gainers_count"),
            count_where(ret < 0).alias("losers_count"),
            F.max(ret).alias("best_performer_return"),
            F.min(ret).alias("worst_performer_return"),
        )
        .withColumn(
            "sector_sentiment",
            F.when(F.col("avg_daily_return_pct") > SENTIMENT_PCT, "Positive")
            .when(F.col("avg_daily_return_pct") < -SENTIMENT_PCT, "Negative")
            .otherwise("Neutral"),
        )
    )


def top_movers_daily(daily: DataFrame, k: int = TOP_MOVERS) -> DataFrame:
    """Best and worst returns per day.

    Each bar is offered once as gainer and once as loser, so both rankings share
    one scan and one shuffle, which carries at most ``k`` rows per group and task.
    """
    sides = F.array(
        F.struct(F.lit("Gainer").alias("mover_type"), (-F.col("daily_return_pct")).alias("_key")),
        F.struct(F.lit("Loser").alias("mover_type"), F.col("daily_return_pct").alias("_key")),
    )
    offered = (
        daily.where(F.col("daily_return_pct").isNotNull())
        .select(DATE, KEY, "sector", "close", "daily_return_pct", "volume", "volume_vs_avg_pct", "trend_signal",
                F.inline(sides))
    )
    order = [F.col("_key").asc(), F.col(KEY).asc()]
    return top_per_group(offered, [DATE, "mover_type"], order, k, "rank_position").select(
        DATE, KEY, "sector", "mover_type", "rank_position", "close", "daily_return_pct", "volume",
        "volume_vs_avg_pct", "trend_signal",
    )


def market_overview_daily(daily: DataFrame) -> DataFrame:
    """Market breadth, volatility and sentiment: one row per day."""
    trend, ret, close = F.col("trend_signal"), F.col("daily_return_pct"), F.col("close")
    up, down = F.col("advancing_stocks"), F.col("declining_stocks")
    return (
        daily.groupBy(DATE)
        .agg(
            F.count(KEY).alias("total_stocks"),
            # Sectors are few: a set that tasks merge, where a distinct count would send a row a sector with all sums.
            F.size(F.collect_set("sector")).cast("long").alias("sectors_tracked"),
            mean(ret, 2).alias("market_avg_return_pct"),
            F.round(F.stddev(ret), 2).alias("market_volatility"),
            F.round(F.percentile_approx(ret, 0.5), 2).alias("median_return_pct"),
            mean(close, 2).alias("avg_stock_price"),
            mean("price_range", 2).alias("avg_price_range"),
            F.sum("volume").alias("total_market_volume"),
            mean_count("volume").alias("avg_stock_volume"),
            count_where(ret > 0).alias("advancing_stocks"),
            count_where(ret < 0).alias("declining_stocks"),
            count_where(ret == 0).alias("unchanged_stocks"),
            count_where(trend == "Bullish").alias("bullish_trends"),
            count_where(trend == "Bearish").alias("bearish_trends"),
            *[count_where(close > F.col(f"ma_{n}")).alias(f"above_ma{n}_count") for n in MA_ROWS],
            F.max(ret).alias("best_stock_return"),
            F.min(ret).alias("worst_stock_return"),
        )
        .withColumns(
            {
                "advance_decline_ratio": F.round(ratio(up, down), 2),
                "market_sentiment": F.when(up > down * BREADTH_FACTOR, "Bullish")
                .when(down > up * BREADTH_FACTOR, "Bearish")
                .otherwise("Neutral"),
            }
        )
    )


def stock_relative_strength(
    silver: DataFrame, sectors: DataFrame, store: Callable[[DataFrame], DataFrame] = stored
) -> DataFrame:
    """Each stock against its sector and the market, and its rank in the sector.

    A sector on a day may hold very many stocks, so the rank is not taken in one
    window over them: all bars are numbered in the order of sector, day, return
    and ticker over many tasks (``store`` writes them once), and a rank is a
    bar's number beyond the first of its sector and day. Sector and market means
    come from one pre-aggregated pass over the numbered bars.
    """
    ret = F.col("daily_return_pct")
    exact = ret.cast(RETURN)
    bars = with_sector(silver.select(KEY, DATE, "close", "daily_return_pct"), sectors).withColumn("_mapped", F.col("sector").isNotNull())
    # The rows that are dealt by range carry nothing that their other columns tell.
    bars = bars.withColumn("_sector", F.coalesce("sector", F.lit(""))).drop("sector")
    group = ["_sector", "_mapped", DATE]
    # Best return first; a missing one ranks last.
    bars = numbered(bars, [*group, exact.desc_nulls_last(), KEY], "_number", store)
    in_market = Window.partitionBy(DATE)

    def mean_of(total: Column, seen: Column) -> Column:
        # The narrower decimal leaves the quotient enough digits to round once.
        return F.round(ratio(total.cast("decimal(28,4)"), seen), 2).cast("double")

    benchmarks = (
        bars.groupBy(*group)
        .agg(F.sum(exact).alias("_total"), F.count(exact).alias("_seen"), F.count(KEY).alias("total_in_sector"), F.min("_number").alias("_first"))
        .select(
            *group,
            mean_of(F.sum("_total").over(in_market), F.sum("_seen").over(in_market)).alias("market_return_pct"),
            # A NULL sector matches no sector benchmark.
            F.when(F.col("_mapped"), mean_of(F.col("_total"), F.col("_seen"))).alias("sector_return_pct"),
            "total_in_sector",
            "_first",
        )
    )
    rank = (F.col("_number") - F.col("_first") + 1).cast("int")
    ranked = bars.join(benchmarks, group).withColumns({"rank_in_sector": rank, "sector": F.when(F.col("_mapped"), F.col("_sector"))})
    versus_sector, versus_market = F.col("outperformance_vs_sector_pct"), F.col("outperformance_vs_market_pct")
    return (
        ranked.withColumns(
            {
                "outperformance_vs_sector_pct": difference(ret, "sector_return_pct", 2),
                "outperformance_vs_market_pct": difference(ret, "market_return_pct", 2),
                "sector_vs_market_pct": difference("sector_return_pct", "market_return_pct", 2),
                "percentile_in_sector": F.round(
                    (1 - (F.col("rank_in_sector") - 1) / F.col("total_in_sector")) * 100, 1
                ),
            }
        )
        .withColumn(
            "relative_strength_label",
            F.when((versus_sector > 0) & (versus_market > 0), "Sector Leader")
            .when((versus_sector > 0) & (versus_market <= 0), "Sector Outperformer")
            .when((versus_sector <= 0) & (versus_market > 0), "Market Outperformer")
            .otherwise("Underperformer"),
        )
        .select(
            KEY, "sector", DATE, "close", "daily_return_pct", "sector_return_pct", "market_return_pct",
            "outperformance_vs_sector_pct", "outperformance_vs_market_pct", "sector_vs_market_pct",
            "percentile_in_sector", "rank_in_sector", "relative_strength_label",
        )
    )


def sector_daily_reduced(sector_daily: DataFrame) -> DataFrame:
    """The three measures of the short sector table."""
    return sector_daily.select("sector", DATE, "stock_count", "avg_daily_return_pct", "total_volume")


def gainers_reduced(movers: DataFrame) -> DataFrame:
    """The short movers table: gainers without their rank."""
    return movers.where("mover_type = 'Gainer'").select(DATE, KEY, "sector", "daily_return_pct", "close")
