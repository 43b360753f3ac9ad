"""Landed bar files and the ticker universe."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.schemas import BAR_COLUMNS, BAR_SCHEMA

# Column titles of the vendor's frames and our names for them.
VENDOR_COLUMNS = {
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
}


def read_json_bars(spark: SparkSession, path: str) -> DataFrame:
    """All bars below a landing directory, one sub-directory per drop."""
    return spark.read.schema(BAR_SCHEMA).option("recursiveFileLookup", "true").json(path)


def normalise_bars(
    df: DataFrame,
    source: str,
    ingested_at: datetime,
    ticker: str | None = None,
    ingestion_date: date | None = None,
) -> DataFrame:
    """Vendor frame to bronze bars: rename, stamp, keep the known columns.

    ``ticker`` stamps a single-symbol file; leave it out when the frame carries
    its own ``ticker`` column.
    """
    stamps = {
        "ingestion_timestamp": F.lit(ingested_at).cast("timestamp"),
        "source": F.lit(source),
        "ingestion_date": F.lit(ingestion_date or ingested_at.date()),
    }
    if ticker is not None:
        stamps["ticker"] = F.lit(ticker)
    out = df.withColumnsRenamed(VENDOR_COLUMNS).withColumns(stamps)
    return out.select(*[c for c in BAR_COLUMNS if c in out.columns])


def backfill_range(as_of: date, years: int = 5) -> tuple[date, date]:
    """Range of the first load: whole years of 365 days up to ``as_of``."""
    return as_of - timedelta(days=365 * years), as_of


def daily_range(as_of: date) -> tuple[date, date]:
    """Range of a daily load: the day before ``as_of``."""
    return as_of - timedelta(days=1), as_of


#: Column and number of the hashed parts that a landing period's bars are laid out in.
BUCKET, BUCKETS = "ticker_bucket", 4


def symbol(c: str) -> Column:
    """How symbols compare: trimmed and in upper case."""
    return F.upper(F.trim(c))


def bucket_of(name: Column, buckets: int = BUCKETS) -> Column:
    """The part of a landing period that a symbol's bars are in."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Bars with the part they are laid out in; their number bounds the folders below a landing period."""
    return df.withColumn(BUCKET, bucket_of(symbol("ticker"), buckets))


def in_range(df: DataFrame, start: date, end: date, date_col: str = "date") -> DataFrame:
    """Bars from ``start`` up to, not including, ``end``.

    No bar lands before the month it trades in, so landing periods before that of ``start`` are not read.
    """
    own = (F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end))
    if "ingestion_date" in df.columns:
        own &= (F.col("ingestion_date") >= F.lit(start.replace(day=1))) | F.col("ingestion_date").isNull()
    return df.where(own)


def universe(config: DataFrame) -> DataFrame:
    """Symbols to ingest, in order of their id."""
    return config.where("is_active").orderBy("ticker_id").select("ticker_symbol")


def restrict_to_universe(bars: DataFrame, config: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Bars of active tickers; symbols compare trimmed and in upper case.

    Of bars that are laid out by hashed ticker, the parts that hold no active one are not read: the universe's parts
    prune the scan while it runs.
    """
    active = config.where(F.col("is_active") & F.col("ticker_symbol").rlike("\\S")).select(symbol("ticker_symbol").alias("_symbol"))
    match = symbol("ticker") == F.col("_symbol")
    if BUCKET in bars.columns:
        active = active.withColumn("_bucket", bucket_of(F.col("_symbol"), buckets))
        match = (F.col(BUCKET) == F.col("_bucket")) & match
    return bars.join(active, match, "left_semi")
