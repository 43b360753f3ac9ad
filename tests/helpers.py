"""Hand-made frames."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = date(2020, 1, 1)

BAR_DDL = (
    "ticker string, date timestamp, open double, high double, low double, close double, volume long, "
    "ingestion_timestamp timestamp, source string, ingestion_date date, record_id string"
)


def bar(ticker="AAA.NS", day=0, open=10.0, high=12.0, low=9.0, close=11.0, volume=100, hour=18, rid="r0"):
    at = datetime.combine(START, datetime.min.time()) + timedelta(days=day)
    return (ticker, at, open, high, low, close, volume, at + timedelta(hours=hour), "test", START, rid)


def bars(spark: SparkSession, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), BAR_DDL)


def silver(spark: SparkSession, series: dict[str, list[float]], gap: int = 1, volume: int = 100) -> DataFrame:
    """Silver rows from close prices; the open is 100, so returns are close - 100."""
    rows = [
        (t, START + timedelta(days=i * gap), 100.0, max(100.0, c) + 1, min(100.0, c) - 1, c, volume, round(c - 100.0, 4))
        for t, closes in series.items()
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(
        rows,
        "ticker_standard string, date date, open double, high double, low double, close double, volume long, "
        "daily_return_pct double",
    ).withColumn("price_range", F.round(F.col("high") - F.col("low"), 2))


def sectors(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "ticker_standard string, sector string")


def rows_by(df: DataFrame, *keys: str) -> dict:
    out = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        out[key[0] if len(keys) == 1 else key] = r
    return out
