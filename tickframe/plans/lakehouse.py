"""The bronze, silver and gold tables of one source, written once and read back.

Every gold table and screen reads silver, so silver is a written table rather
than a plan each of them would run again. Tables live in the shared folder the
session names in ``spark.checkpoint.dir``: a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.operators.clean import KEYS, clean, conform, enrich, keep_latest
from tickframe.operators.quality import RuleSet, bar_rules
from tickframe.operators.upsert import read_if_exists, upsert_table
from tickframe.plans import gold, incremental
from tickframe.plans.screens import MONTH
from tickframe.schemas import LAYER_METRICS
from tickframe.sinks import clustered, exists, overwrite_partitions, write_table
from tickframe.sources.bars import BUCKET, with_bucket
from tickframe.staging import shared_folder, stored

BRONZE, SECTORS = "bronze.stock_prices_raw", "gold.ticker_sector_mapping"
SILVER, QUARANTINE = "silver.stock_prices_clean", "silver.stock_prices_quarantine"

FEATURES, STRENGTH = "gold.stock_features", "stock_relative_strength"

#: Bronze is laid out by landing period and, below that, by hashed ticker.
BRONZE_LAYOUT = ("ingestion_date", BUCKET)

PER_STOCK = {
    "stock_daily_metrics": gold.DAILY_COLUMNS,
    "stock_multitime_performance": gold.MULTITIME_COLUMNS,
    "stock_technical_levels": gold.TECHNICAL_COLUMNS,
}
INPUT = {
    "sector_daily_metrics": gold.SECTOR_INPUT,
    "top_movers_daily": gold.MOVERS_INPUT,
    "market_overview_daily": gold.OVERVIEW_INPUT,
}
FROM_DAILY = {
    "sector_daily_metrics": gold.sector_daily_metrics,
    "top_movers_daily": gold.top_movers_daily,
    "market_overview_daily": gold.market_overview_daily,
}

# The table each written table is read from, for its audit row.
READS = {
    SILVER: BRONZE, QUARANTINE: BRONZE, FEATURES: SILVER, "gold.stock_relative_strength": SILVER,
    **{f"gold.{name}": SILVER for name in PER_STOCK}, **{f"gold.{name}": FEATURES for name in FROM_DAILY},
}

def silver_bars(bronze: DataFrame, exchange_tz: str | None = None, buckets: int | None = None) -> DataFrame:
    """Typed, valid, unique bars.

    What follows from a bar's other columns is derived from the bars that are kept: it cannot tell two of them apart,
    and would only widen the rows that are sorted and shuffled. With ``buckets`` the one shuffle deals the bars by
    ticker into so many parts, for ``write_bucketed``; the repeated bars of a ticker go to its part too.
    """
    valid = RuleSet(bar_rules()).valid(conform(bronze, exchange_tz))
    return enrich(keep_latest(valid if buckets is None else valid.repartition(buckets, KEYS[0])))


def quarantined_bars(bronze: DataFrame, at: datetime | None = None, exchange_tz: str | None = None) -> DataFrame:
    """Bars that break a rule, with the reasons."""
    return RuleSet(bar_rules()).quarantined(clean(bronze, exchange_tz), at)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, F.trunc("date", "MM"))


def refresh_silver(
    spark: SparkSession, bronze: DataFrame, path: str, staging: str, quarantine: str | None = None,
    since: date | None = None, at: datetime | None = None, exchange_tz: str | None = None,
) -> None:
    """Merge the bars landed on or after ``since`` into the silver table at ``path``.

    The table is kept by month of the trading day, which follows from the merge
    key, so a daily refresh rewrites the months it has bars for and no others.
    Bars that break a rule go to the table at ``quarantine``, kept by landing day:
    a refresh replaces the days it covers, so repeating it adds nothing. ``bronze``
    is read for either: a copy with the flags of all bars would cost more.
    """
    landed = bronze if since is None else bronze.where(F.col("ingestion_date") >= F.lit(since))
    upsert_table(spark, path, with_month(silver_bars(landed, exchange_tz)), KEYS, MONTH, staging, check=False, cluster=False)
    if quarantine is not None:
        days = ("ingestion_date",)
        overwrite_partitions(clustered(quarantined_bars(landed, at, exchange_tz), days), quarantine, days)


class Lakehouse:
    """Tables derived from one bronze frame and one sector mapping.

    A table that exists below ``root`` is read as it is, unless ``rebuild`` asks
    to derive it anew. The per-stock tables have a column ``month``; with
    ``by_month`` they are also laid out by it, so that a screen of one day reads
    one month: worth it from some ten million bars, below that it makes small
    files. ``block_rows`` splits the series of the rolling windows into blocks of
    about so many bars; a series of daily bars fits a task without that. Neither
    changes a result. ``clock`` gives the times of the audit rows. A lake by month
    may be restricted to the gold tables in ``only``: the per-stock table then has
    the columns these need.
    """

    def __init__(
        self, spark: SparkSession, bronze: DataFrame, sectors: DataFrame, root: str | None = None,
        by_month: bool = False, block_rows: int | None = None, rebuild: bool = False,
        clock: Callable[[], datetime] = datetime.now, only: Sequence[str] | None = None,
    ):
        if only is not None and not by_month:
            raise ValueError("only a lake that is laid out by month can be restricted to some tables")
        self.spark, self._bronze, self._sectors = spark, bronze, sectors
        self.names = [name for name in (*PER_STOCK, *FROM_DAILY, STRENGTH) if only is None or name in only]
        wanted = dict.fromkeys(c for name in self.names for c in {**PER_STOCK, **INPUT}.get(name, ()))
        self.feature_columns = ["*"] if only is None else list(wanted)
        self.root = root or shared_folder(spark)
        self.by_month, self.block_rows, self.rebuild, self.clock = by_month, block_rows, rebuild, clock
        self._tables: dict[str, DataFrame] = {}
        self.rows: dict[str, int] = {}
        self._times: dict[str, tuple[datetime, datetime]] = {}
        self._errors: dict[str, str] = {}

    def written(
        self, name: str, plan: Callable[[], DataFrame], monthly: bool = False, layout: tuple[str, ...] = (), cluster: bool = True
    ) -> DataFrame:
        """The table ``name``: read if it exists, else written, and counted."""
        if name not in self._tables:
            path, start = f"{self.root}/{name}", self.clock()
            table = None if self.rebuild else read_if_exists(self.spark, path)
            if table is None:
                try:
                    rows = with_month(plan()) if monthly else plan()
                    write_table(rows, path, (MONTH,) if monthly and self.by_month else layout, cluster=cluster)
                except Exception as error:
                    self._times[name], self._errors[name] = (start, self.clock()), str(error)
                    raise
                # The schema is known, so reading back needs no look at the files.
                table = self.spark.read.schema(rows.schema).parquet(path)
                self._times[name] = (start, self.clock())
                self._errors.pop(name, None)
            self.rows[name] = table.count()
            self._tables[name] = table
        return self._tables[name]

    @property
    def bronze(self) -> DataFrame:
        return self.landed.drop(BUCKET)

    @property
    def landed(self) -> DataFrame:
        """Bronze with the column it is laid out by."""
        return self.written(BRONZE, lambda: with_bucket(self._bronze), layout=BRONZE_LAYOUT)

    @property
    def sectors(self) -> DataFrame:
        return self.written(SECTORS, lambda: self._sectors)

    @property
    def silver(self) -> DataFrame:
        return self.written(SILVER, lambda: silver_bars(self.bronze), monthly=True, cluster=False)

    @property
    def quarantine(self) -> DataFrame:
        return self.written(QUARANTINE, lambda: quarantined_bars(self.bronze, self.clock()))

    def _features(self) -> DataFrame:
        return gold.stock_features(self.silver, self.sectors, self.block_rows).select(*self.feature_columns)

    def _written_features(self) -> DataFrame:
        return self.written(FEATURES, self._features, monthly=True, cluster=False)

    def plan(self, name: str) -> DataFrame:
        """The plan of a gold table over the written tables it derives from."""
        if name in PER_STOCK:
            return gold.stock_features(self.silver, self.sectors, self.block_rows).select(*PER_STOCK[name])
        if name == "stock_relative_strength":
            return gold.stock_relative_strength(self.silver, self.sectors)
        return FROM_DAILY[name](self._written_features() if self.by_month else self.gold("stock_daily_metrics"))

    def gold(self, name: str) -> DataFrame:
        """A written gold table; the per-stock tables share one where the lake has it or is laid out by month, else each has its own columns alone."""
        if name not in self.names:
            raise ValueError(f"{name} is not among the tables of this lake")
        if name in PER_STOCK and (self.by_month or FEATURES in self._tables or exists(self.spark, f"{self.root}/{FEATURES}")):
            return self._written_features().select(*PER_STOCK[name], MONTH)
        table = self.written(f"gold.{name}", lambda: self.plan(name), monthly=True, cluster=name in FROM_DAILY)
        return table if name in (*PER_STOCK, STRENGTH) else table.drop(MONTH)

    def build(self, layer: str = "all") -> None:
        """Write the tables of one layer, with those they derive from, or of all."""
        if layer in ("all", "bronze"):
            self.bronze
        if layer in ("all", "silver"):
            self.silver, self.quarantine
        if layer in ("all", "gold"):
            if any(name != STRENGTH for name in self.names):
                self._written_features()
            for name in self.names:
                self.gold(name)

    def refresh(self, landed: DataFrame, names: Sequence[str] | None = None) -> None:
        """Take in newly landed bars: append them to bronze, merge them into silver, bring the gold tables up to date.

        These are all gold tables, or, with ``names``, those and the ones that the lake has already.

        For tables laid out by month. Months that the new bars do not reach are not rewritten; the result equals a
        rebuild from all bars, if bars of a ticker and day land in the order they are taken in. One caller at a time;
        a call that failed is repeated after removing what it appended to bronze.
        """
        if not self.by_month:
            raise ValueError("only a lake that is laid out by month can be refreshed")
        self.build("bronze")
        self.build("silver")
        for name in self.names:
            own = FEATURES if name in PER_STOCK else f"gold.{name}"
            if names is None or name in names or exists(self.spark, f"{self.root}/{own}"):
                self.gold(name)
        path = {name: f"{self.root}/{name}" for name in (BRONZE, SILVER, QUARANTINE, FEATURES)}
        staging = shared_folder(self.spark)
        write_table(with_bucket(landed).select(*self.landed.columns), path[BRONZE], BRONZE_LAYOUT, mode="append")
        flagged = stored(RuleSet(bar_rules()).flag(clean(landed)))
        helpers = [r.column for r in bar_rules()]
        valid = stored(with_month(keep_latest(flagged.where("is_valid").drop(*helpers, "is_valid", "failure_reasons"))))
        upsert_table(self.spark, path[SILVER], valid, KEYS, MONTH, f"{staging}/silver", check=False, cluster=False)
        bad = flagged.where(~F.col("is_valid")).withColumn("quarantine_timestamp", F.lit(self.clock()).cast("timestamp"))
        write_table(bad.select(*self.quarantine.columns), path[QUARANTINE], mode="append")

        self._reread(BRONZE, SILVER, QUARANTINE)
        if FEATURES in self._tables:
            months = incremental.refresh_features(self.silver, self.sectors, valid.select(*KEYS), path[FEATURES], self.feature_columns)
            self._reread(FEATURES)
            daily = {name: make for name, make in FROM_DAILY.items() if f"gold.{name}" in self._tables}
            incremental.refresh_months(
                months, self._written_features(), {f"{self.root}/gold.{name}": make for name, make in daily.items()},
            )
            self._reread(*[f"gold.{name}" for name in daily])
        if f"gold.{STRENGTH}" in self._tables:
            incremental.refresh_months(
                incremental.months_of(valid), self.silver,
                {f"{self.root}/gold.{STRENGTH}": lambda df: gold.stock_relative_strength(df, self.sectors)},
            )
            self._reread(f"gold.{STRENGTH}")

    def _reread(self, *names: str) -> None:
        """Look at tables again whose files have changed, and count them."""
        for name in names:
            self._tables[name] = self.spark.read.schema(self._tables[name].schema).parquet(f"{self.root}/{name}")
            self.rows[name] = self._tables[name].count()

    def metrics(self, run_id: str) -> DataFrame:
        """Audit rows of the tables written so far, and of those whose writing failed."""
        rows = []
        for name, (start, end) in self._times.items():
            source = READS.get(name, "")
            if source == FEATURES and FEATURES not in self.rows:
                source = "gold.stock_daily_metrics"
            layer, read = name.split(".")[0], self.rows.get(source, 0)
            seconds = (end - start).total_seconds()
            error = self._errors.get(name)
            rows.append((
                f"{run_id}:{name}", run_id, layer, name, "INSERT", read, self.rows.get(name, 0), 0, 0, 0, 0,
                start, end, seconds, "FAILED" if error else "SUCCESS", error, start.date(), end,
            ))
        return self.spark.createDataFrame(rows, LAYER_METRICS)
