from __future__ import annotations

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from tests.helpers import bar, bars, sectors
from tickframe.plans import incremental
from tickframe.plans.lakehouse import Lakehouse

GOLD = ["stock_daily_metrics", "stock_technical_levels", "stock_multitime_performance", "stock_relative_strength",
        "sector_daily_metrics", "top_movers_daily", "market_overview_daily"]


def history(spark, days):
    rows = [bar(f"{t}.NS", d, 100.0, 103.0 + (d * k) % 17, 95.0, 102.0 + (d * k) % 17, 100 + (d * k) % 400, rid=f"{t}{d}")
            for k, t in enumerate("ABCD", 3) for d in days]
    return bars(spark, *rows)


@pytest.fixture(scope="module")
def dim(spark):
    return sectors(spark, {"A": "S", "B": "S", "C": "T"})


def files(root, table):
    """Files by month of a table."""
    return {m: sorted(f for f in os.listdir(f"{root}/{table}/{m}") if f.endswith(".parquet")) for m in os.listdir(f"{root}/{table}") if m.startswith("month=")}


def test_refreshed_lake_equals_a_rebuilt_one(spark, dim, tmp_path):
    everything = history(spark, range(0, 900, 1))
    # Held back: one month of all tickers, one bar that corrects an earlier one, and an unknown ticker's only bar; one breaks a rule.
    held = F.to_date("date").between(date(2020, 7, 1), date(2020, 7, 31))
    more = bars(spark, bar("A.NS", 200, close=99.0, high=120.0, hour=30, rid="z"), bar("E.NS", 210), bar("B.NS", 211, low=-1.0, hour=31, rid="y"))
    landed = everything.where(held).unionByName(more)
    lake = Lakehouse(spark, everything.where(~held), dim, root=str(tmp_path / "lake"), by_month=True)
    lake.build()
    before = {t: files(lake.root, t) for t in ("gold.stock_features", "gold.sector_daily_metrics", "gold.stock_relative_strength", "silver.stock_prices_clean")}
    lake.refresh(landed)
    rebuilt = Lakehouse(spark, everything.unionByName(more), dim, root=str(tmp_path / "rebuilt"), by_month=True)
    for name in GOLD:
        assert differences(lake.gold(name).toPandas(), rebuilt.gold(name).toPandas()) == [], name
    assert differences(lake.silver.toPandas(), rebuilt.silver.toPandas()) == []
    drop = "quarantine_timestamp"
    assert differences(lake.quarantine.drop(drop).toPandas(), rebuilt.quarantine.drop(drop).toPandas()) == []
    assert lake.rows["gold.stock_features"] == rebuilt.gold("stock_daily_metrics").count()
    # 251 bars beyond the last change: from July 2020 to April 2021; silver and the daily ranks of July alone.
    changed = {t: {m[6:13] for m, own in files(lake.root, t).items() if own != before[t].get(m)} for t in before}
    reach = {f"2020-{m:02}" for m in range(7, 13)} | {f"2021-{m:02}" for m in range(1, 5)}
    assert changed["gold.stock_features"] == changed["gold.sector_daily_metrics"] == reach
    assert changed["gold.stock_relative_strength"] == changed["silver.stock_prices_clean"] == {"2020-07"}


def test_reach_of_changed_bars(spark):
    first = date(2020, 1, 1)
    days = [(t, first + timedelta(days=2 * k)) for t in "AB" for k in range(20)]
    schema = "ticker_standard string, date date"
    silver = spark.createDataFrame(days, schema)
    changed = spark.createDataFrame([("A", days[8][1]), ("A", days[9][1])], schema)
    row = incremental.reached(silver, changed, lookback=3).collect()
    assert [(r.ticker_standard, r.start, r["first"], r["last"]) for r in row] == [("A", days[5][1], days[8][1], days[12][1])]
    assert incremental.reached(silver, changed.limit(0)).count() == 0
    whole = incremental.reached(silver, changed, lookback=100).first()
    assert (whole.start, whole["last"]) == (first, days[19][1])


def test_months_that_changes_reach(spark):
    first = date(2020, 1, 20)
    days = [("A", first + timedelta(days=9 * k)) for k in range(20)] + [("B", date(2020, 12, 1)), ("C", first)]
    schema = "ticker_standard string, date date"
    silver = spark.createDataFrame(days, schema)
    changed = spark.createDataFrame([days[8], days[9], days[20]], schema)
    # Three bars on from the tenth, and the one bar of another stock; no month between.
    assert sorted(incremental.months_reached(silver, changed, 3)) == [date(2020, m, 1) for m in (4, 5, 12)]
    assert incremental.months_reached(silver, changed.limit(0)) == []


def test_nothing_landed_changes_nothing(spark, dim, tmp_path):
    lake = Lakehouse(spark, history(spark, range(40)), dim, root=str(tmp_path / "same"), by_month=True)
    lake.build()
    before = files(lake.root, "gold.stock_features")
    lake.refresh(history(spark, range(1)).limit(0))
    assert files(lake.root, "gold.stock_features") == before and lake.rows["gold.stock_features"] == 160
    with pytest.raises(ValueError):
        Lakehouse(spark, history(spark, range(2)), dim, root=str(tmp_path / "flat")).refresh(history(spark, range(1)))


def test_refresh_of_some_tables(spark, dim, tmp_path):
    everything = history(spark, range(0, 500, 1))
    held = F.to_date("date").between(date(2020, 7, 1), date(2020, 7, 31))
    lake = Lakehouse(spark, everything.where(~held), dim, root=str(tmp_path / "some"), by_month=True)
    lake.gold("top_movers_daily")
    lake.refresh(everything.where(held), ["market_overview_daily"])
    # The table asked for, the one that was there, and the one they are read from.
    assert {t for t in os.listdir(lake.root) if t.startswith("gold.")} == {
        "gold.stock_features", "gold.ticker_sector_mapping", "gold.top_movers_daily", "gold.market_overview_daily"
    }
    rebuilt = Lakehouse(spark, everything, dim, root=str(tmp_path / "all"), by_month=True)
    for name in ("top_movers_daily", "market_overview_daily", "stock_daily_metrics"):
        assert differences(lake.gold(name).toPandas(), rebuilt.gold(name).toPandas()) == [], name


def test_bars_looked_back_on(spark):
    first = date(2020, 1, 1)
    days = [(t, first + timedelta(days=k)) for t, some in (("A", range(20)), ("B", (12,)), ("C", (3, 4))) for k in some]
    silver = spark.createDataFrame(days, "ticker_standard string, date date")
    got = sorted(((r.date - first).days, r.ticker_standard) for r in incremental.with_lookback(silver, first + timedelta(days=10), 2).collect())
    assert got == sorted([(k, "A") for k in range(8, 20)] + [(12, "B"), (3, "C"), (4, "C")])
