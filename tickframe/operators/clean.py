"""Bronze to silver: types, derived columns, keep-latest and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.numeric import clean_double, pct_over
from tickframe.functions.windows import Series, over_series, top_per_group

KEYS = ("ticker_standard", "date")
MAX_GAP_DAYS = 3

# Days of the week, Sunday being 1, on which no market trades.
WEEKEND = (1, 7)


def trading_date(c: str, exchange_tz: str | None = None) -> Column:
    """Calendar day of a bar; ``exchange_tz`` moves UTC instants to local time."""
    if exchange_tz is None:
        return F.to_date(c)
    return F.to_date(F.from_utc_timestamp(F.col(c), exchange_tz))


def standard_ticker(c: str) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), r"\.NS$", "")


def whole_number(c: str, df: DataFrame) -> Column:
    """Long value of a column; NaN and values out of range become NULL."""
    floating = dict(df.dtypes)[c] in ("double", "float")
    return (clean_double(c) if floating else F.col(c)).try_cast("long")


def conform(df: DataFrame, exchange_tz: str | None = None) -> DataFrame:
    """Declared types; unparsable numbers and NaN become NULL for the rules to find."""
    prices = {c: clean_double(c) for c in ("open", "high", "low", "close")}
    return df.withColumns(
        {
            "date": trading_date("date", exchange_tz),
            **prices,
            "volume": whole_number("volume", df),
            "ticker_standard": standard_ticker("ticker"),
        }
    )


def enrich(df: DataFrame) -> DataFrame:
    """Intraday return, range and weekday flag."""
    return df.withColumns(
        {
            "daily_return_pct": pct_over("close", "open", 4),
            "price_range": F.round(F.col("high") - F.col("low"), 2),
            "is_trading_day": ~F.coalesce(F.dayofweek("date").isin(*WEEKEND), F.lit(False)),
        }
    )


def clean(df: DataFrame, exchange_tz: str | None = None) -> DataFrame:
    return enrich(conform(df, exchange_tz))


def keep_latest(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    latest: Sequence[str] = ("ingestion_timestamp", "record_id"),
) -> DataFrame:
    """One row per key: the last ingested, then the greatest tie-breaker, then the greatest of the other columns.

    Each map task keeps one row per key before the shuffle, so a key holding a
    large share of the input does not reach a single task whole.
    """
    first = [c for c in latest if c in df.columns]
    order = [F.col(c).desc_nulls_last() for c in (*first, *[c for c in df.columns if c not in (*keys, *first)])]
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def with_gaps(df: DataFrame, max_gap: int = MAX_GAP_DAYS, key: str = KEYS[0], block_rows: int | None = None) -> DataFrame:
    """Days since the previous bar of the ticker, and whether that is a gap."""

    def build(rows: DataFrame, s: Series) -> DataFrame:
        return (
            rows.withColumn("prev_date", s.lag("date", 1))
            .withColumn("days_gap", F.datediff("date", "prev_date"))
            .withColumn("is_gap", F.coalesce(F.col("days_gap") > max_gap, F.lit(False)))
        )

    return over_series(df, key, "date", 1, build, block_rows)


def gap_report(df: DataFrame, max_gap: int = MAX_GAP_DAYS, block_rows: int | None = None) -> DataFrame:
    slim = df.select("ticker", "ticker_standard", "date")
    return with_gaps(slim, max_gap, block_rows=block_rows).where("is_gap").select("ticker", "date", "prev_date", "days_gap")
