"""Gold tables brought up to date with a changed silver table, month by month.

A changed bar changes its stock's measures on its own day and on the bars that
look back on it. Those are found from the keys that a refresh wrote. The months
they lie in are computed anew as a whole, from their bars and those looked back
on: the rows of a table by month are few columns of silver, so that costs less
than reading, joining and merging the wide rows that such a month has already.
The tables by day and sector are rebuilt for those months only. Other months
are neither read nor written, apart from the bars looked back on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.windows import top_per_group
from tickframe.plans import gold
from tickframe.plans.screens import MONTH
from tickframe.sinks import clustered, overwrite_partitions

LOOKBACK = gold.YEAR_ROWS - 1


def _numbered(silver: DataFrame, changed: DataFrame) -> DataFrame:
    """Days of the stocks with changed bars, with their number ``_n`` in the series, and ``_first`` and ``_last`` of the stretch that changed."""
    key, day = gold.KEY, gold.DATE
    spans = changed.groupBy(key).agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    series, whole = Window.partitionBy(key).orderBy(day), Window.partitionBy(key)
    placed = silver.select(key, day).join(spans, key).withColumn("_n", F.row_number().over(series))

    def at(condition: Column, pick: Callable[[Column], Column]) -> Column:
        return pick(F.when(condition, F.col("_n"))).over(whole)

    return placed.withColumns({"_first": at(F.col(day) >= F.col("_from"), F.min), "_last": at(F.col(day) <= F.col("_to"), F.max)})


def reached(silver: DataFrame, changed: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """One row per stock with changed bars: ``ticker_standard``, ``first`` and ``last`` day whose measures change, ``start`` of the bars they look back on.

    ``changed`` has the keys of the bars that were written. One stock's changes are taken as one stretch.
    """
    key, day = gold.KEY, gold.DATE
    return _numbered(silver, changed).where(F.col("_n").between(F.col("_first") - lookback, F.col("_last") + lookback)).groupBy(key).agg(
        F.min(day).alias("start"), F.min(F.when(F.col("_n") >= F.col("_first"), F.col(day))).alias("first"), F.max(day).alias("last")
    )


def months_of(df: DataFrame) -> list:
    """The months in which a frame has bars: at most as many as a table has folders."""
    return [row[0] for row in df.select(F.trunc(gold.DATE, "MM").alias(MONTH)).distinct().collect()]


def months_reached(silver: DataFrame, changed: DataFrame, lookback: int = LOOKBACK) -> list:
    """The months that hold bars which ``reached`` spans: read off the numbered days, of which those before any change are left out."""
    earliest = changed.agg(F.min(gold.DATE)).first()[0]
    if earliest is None:
        return []
    numbered = _numbered(silver.where(F.col(gold.DATE) >= F.lit(earliest)), changed)
    return months_of(numbered.where(F.col("_n").between(F.col("_first"), F.col("_last") + lookback)))


def with_lookback(silver: DataFrame, start: date, lookback: int = LOOKBACK) -> DataFrame:
    """Bars from the day ``start`` on, and of each stock the ``lookback`` bars before."""
    key, day = gold.KEY, F.col(gold.DATE)
    before = top_per_group(silver.select(key, gold.DATE).where(day < F.lit(start)), [key], [day.desc()], lookback, "_n")
    begins = before.groupBy(key).agg(F.min(day).alias("_begin"))
    return silver.join(begins, key, "left").where(day >= F.coalesce("_begin", F.lit(start))).drop("_begin")


def refresh_features(silver: DataFrame, sectors: DataFrame, changed: DataFrame, path: str, columns: Sequence[str] = ("*",)) -> list:
    """Compute the months anew that hold measures which ``changed`` bars reach, in the table at ``path`` of some columns; gives these months.

    Rows are written by the task that has their stock's series: as wide as they are, they would take most of a shuffle.
    """
    months = months_reached(silver, changed)
    if months:
        month = F.trunc(gold.DATE, "MM")
        bars = with_lookback(silver.where(month <= F.lit(max(months))), min(months))
        features = gold.stock_features(bars, sectors).select(*columns).withColumn(MONTH, month).where(F.col(MONTH).isin(months))
        overwrite_partitions(features, path, (MONTH,))
    return months


def refresh_months(months: list, source: DataFrame, tables: Mapping[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Rebuild whole months of tables by path, from those months of their source."""
    if months:
        own = source.where(F.col(MONTH).isin(months))
        for path, build in tables.items():
            overwrite_partitions(clustered(build(own).withColumn(MONTH, F.trunc(gold.DATE, "MM")), (MONTH,)), path, (MONTH,))
