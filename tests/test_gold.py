from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from tests.helpers import START, rows_by, sectors, silver
from tickframe.operators.numbering import numbered
from tickframe.plans import gold
from tickframe.staging import stored


def one_day(spark, returns: dict[str, float | None]):
    """One bar per ticker on one day with the given return."""
    df = silver(spark, {t: [100.0] for t in returns})
    table = spark.createDataFrame(list(returns.items()), "ticker_standard string, r double")
    return df.drop("daily_return_pct").join(table, "ticker_standard").withColumnRenamed("r", "daily_return_pct")


def daily(spark, returns, mapping=None):
    return gold.stock_daily_metrics(one_day(spark, returns), sectors(spark, mapping or {t: "S" for t in returns}))


def test_movers_break_ties_by_ticker_and_leave_out_missing_returns(spark):
    returns = {f"T{i:02d}": 1.0 for i in range(12)} | {"NONE": None, "BEST": 5.0, "WORST": -5.0}
    out = gold.top_movers_daily(daily(spark, returns))
    got = {m: [r.ticker_standard for r in out.where(F.col("mover_type") == m).orderBy("rank_position").collect()]
           for m in ("Gainer", "Loser")}
    tied = [f"T{i:02d}" for i in range(9)]
    assert got == {"Gainer": ["BEST", *tied], "Loser": ["WORST", *tied]}


def test_movers_share_one_limited_shuffle(spark):
    plan = gold.top_movers_daily(daily(spark, {"A": 1.0}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.count("Exchange hashpartitioning(date") == 1


@pytest.mark.parametrize(
    "returns, ratio, sentiment",
    [
        ({"A": 1.0, "B": 2.0}, None, "Bullish"),
        ({"A": -1.0, "B": -2.0}, 0.0, "Bearish"),
        ({"A": 0.0, "B": 0.0}, None, "Neutral"),
        ({"A": 1.0, "B": 1.0, "C": 1.0, "D": -1.0, "E": -1.0}, 1.5, "Neutral"),
    ],
)
def test_market_breadth(spark, returns, ratio, sentiment):
    row = gold.market_overview_daily(daily(spark, returns)).first()
    assert row.advance_decline_ratio == ratio
    assert row.market_sentiment == sentiment
    unknown = sum(r is None for r in returns.values())
    assert row.advancing_stocks + row.declining_stocks + row.unchanged_stocks + unknown == row.total_stocks


def test_sector_of_one_stock_has_no_volatility(spark):
    row = gold.sector_daily_metrics(daily(spark, {"A": 1.5}, {"A": "S"})).first()
    assert row.return_volatility is None and row.sector_sentiment == "Positive"
    assert gold.sector_daily_metrics(daily(spark, {"A": 1.5}, {"B": "S"})).count() == 0


def test_relative_strength_ranks_and_unmapped_sector(spark):
    returns = {"A": 3.0, "B": 1.0, "C": -4.0, "D": None, "X": 8.0, "Y": 7.0}
    table = gold.stock_relative_strength(one_day(spark, returns), sectors(spark, {t: "S" for t in "ABCD"}))
    got = rows_by(table, "ticker_standard")
    assert [got[t].rank_in_sector for t in "ABCD"] == [1, 2, 3, 4]
    assert [got[t].percentile_in_sector for t in "ABCD"] == [100.0, 75.0, 50.0, 25.0]
    assert got["A"].sector_return_pct == 0.0 and got["A"].market_return_pct == 3.0
    assert got["A"].relative_strength_label == "Sector Outperformer"
    assert got["D"].relative_strength_label == "Underperformer"
    # Unmapped stocks are ranked among themselves and have no sector benchmark.
    assert (got["X"].rank_in_sector, got["Y"].rank_in_sector) == (1, 2)
    assert got["X"].sector_return_pct is None and got["X"].outperformance_vs_market_pct == 5.0


def test_numbered_rank_equals_one_window(spark):
    """A hot sector with many tied returns over many ranges."""
    rnd = random.Random(5)
    returns = {f"{rnd.choice('ABC')}{i:04d}": rnd.choice([0.0, None, 0.37, round(rnd.uniform(-9, 9), 4), round(rnd.uniform(-1, 1), 2)]) for i in range(600)}
    df, dim = one_day(spark, returns), sectors(spark, {t: "HOT" if i % 3 else "COLD" for i, t in enumerate(returns)})
    got = gold.stock_relative_strength(df, dim).select("ticker_standard", "rank_in_sector")
    expected = df.join(dim, "ticker_standard").selectExpr(
        "ticker_standard",
        "row_number() OVER (PARTITION BY sector, date ORDER BY daily_return_pct DESC NULLS LAST, ticker_standard) AS rank_in_sector",
    )
    assert differences(got.toPandas(), expected.toPandas()) == []


def test_no_task_orders_all_tickers(spark):
    """The one window without a key is over the sizes of ranges, not over bars or tickers."""
    df, dim = one_day(spark, {"A": 1.0, "B": 2.0}), sectors(spark, {"A": "S"})
    plan = gold.stock_relative_strength(df, dim)._jdf.queryExecution().executedPlan().toString()
    alone = plan.split("Exchange SinglePartition")[1:]
    assert alone and all("ReadSchema: struct<_part:int>" in below.split("FileScan")[1] for below in alone)


def test_rows_are_numbered_over_all_ranges(spark):
    rows = [(rnd, k) for k, rnd in enumerate(random.Random(3).choices([None, 1, 2, 2, 5, 9], k=500))]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {(r.a, r.b): r.n for r in numbered(df, ["a", "b"], "n", stored).collect()}
    assert [got[x] for x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))] == list(range(500))
    assert numbered(df.limit(0), ["a", "b"], "n", stored).count() == 0


def test_numbering_shuffles_the_rows_once(spark):
    df = spark.createDataFrame([(2, "x"), (None, "y"), (1, "z")], "a int, b string")
    out = numbered(df, [F.col("a").desc_nulls_last(), "b"], "n", stored)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Rows that are read back keep their place; only the sizes of the ranges are gathered.
    assert "row_number" not in plan and "SortMergeJoin" not in plan
    assert {r.b: r.n for r in out.collect()} == {"x": 0, "z": 1, "y": 2}


def test_technical_flags(spark):
    closes = [100.0] * 25 + [150.0]
    df = silver(spark, {"A": closes}).withColumn(
        "volume", F.when(F.col("close") == 150, 1000).otherwise(100).cast("long")
    )
    table = gold.stock_technical_levels(df, sectors(spark, {"A": "S"})).orderBy(F.desc("date"))
    last, flat = table.first(), table.collect()[1]
    assert last.at_52w_high_flag and last.breakout_30d_high_flag and last.volume_breakout_flag
    assert last.strong_bullish_signal and not last.strong_bearish_signal
    assert last.avg_volume_20d == 145 and last.volume_ratio == 6.9
    assert last.bb_position == "Above Upper Band"
    # Flat prices: both bands meet the price, the upper one is tested first.
    assert flat.bb_upper == flat.bb_lower == 100.0 and flat.bb_position == "Above Upper Band"
    first = table.collect()[-1]
    assert first.bb_upper is None and first.bb_position == "Within Bands" and first.date == START


def test_reduced_tables(spark):
    table = daily(spark, {"A": 1.0, "B": -1.0})
    assert gold.sector_daily_reduced(gold.sector_daily_metrics(table)).columns == [
        "sector", "date", "stock_count", "avg_daily_return_pct", "total_volume",
    ]
    assert [r.ticker_standard for r in gold.gainers_reduced(gold.top_movers_daily(table)).collect()] == ["A", "B"]
