"""Ticker and sector dimensions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.upsert import upsert


def with_sector(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Bars with their sector, NULL where the ticker is not mapped.

    No broadcast hint: Catalyst broadcasts the mapping while its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it.
    """
    return bars.join(sectors.select("ticker_standard", "sector"), "ticker_standard", "left")


def mapped_only(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    return bars.join(sectors.select("ticker_standard", "sector"), "ticker_standard")


def unmapped_keys(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Tickers without a sector; distinct first, so the join sees keys, not bars."""
    return bars.select("ticker_standard").distinct().join(sectors, "ticker_standard", "left_anti")


def sector_map_from_config(config: DataFrame) -> DataFrame:
    return config.where("is_active").select(F.col("ticker_clean").alias("ticker_standard"), "sector").distinct()


def deactivate(config: DataFrame, symbol: str, at: datetime) -> DataFrame:
    hit = F.col("ticker_symbol") == symbol
    return config.withColumns(
        {
            "is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active")),
            "last_updated": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("last_updated")),
        }
    )


def add_tickers(config: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert new symbols and replace known ones."""
    return upsert(config, rows, ["ticker_symbol"])
