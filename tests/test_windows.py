from __future__ import annotations

import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from tests.helpers import sectors, silver

from tickframe.functions.windows import BLOCK, IS_HALO, Series, split_series
from tickframe.plans import gold
from tickframe.sinks import write_bucketed


def half_up(x: Decimal, k: int) -> float:
    return float(x.quantize(Decimal(1).scaleb(-k), ROUND_HALF_UP))


def series(n: int, seed: int) -> list[float]:
    rnd = random.Random(seed)
    return [round(rnd.uniform(60, 140), 2) for _ in range(n)]


def test_rolling_columns_against_plain_python(spark):
    closes = {"A": series(260, 1), "B": series(19, 2), "C": series(1, 3)}
    df = silver(spark, closes)
    daily = gold.stock_daily_metrics(df, sectors(spark, {"A": "x"})).orderBy("ticker_standard", "date").collect()
    tech = gold.stock_technical_levels(df, sectors(spark, {"A": "x"})).orderBy("ticker_standard", "date").collect()
    multi = gold.stock_multitime_performance(df, sectors(spark, {"A": "x"})).orderBy("ticker_standard", "date").collect()
    at = 0
    for ticker in sorted(closes):
        c = closes[ticker]
        for i in range(len(c)):
            row, level, perf = daily[at], tech[at], multi[at]
            at += 1
            for n in (20, 50, 200):
                frame = [Decimal(str(v)) for v in c[max(0, i - n + 1): i + 1]]
                assert row[f"ma_{n}"] == half_up(sum(frame) / len(frame), 2)
            frame = c[max(0, i - 251): i + 1]
            assert level.high_52w == max(100.0, max(frame)) + 1
            assert level.low_52w == min(100.0, min(frame)) - 1
            returns = [round(v - 100.0, 4) for v in c[max(0, i - 29): i + 1]]
            if len(returns) > 1:
                assert perf.volatility_30d == pytest.approx(statistics.stdev(returns), abs=0.0051)
            else:
                assert perf.volatility_30d is None
            assert perf.consistency_score_30d == half_up(Decimal(sum(r > 0 for r in returns)) / 30 * 100, 1)
            assert (perf.return_180d_pct is None) == (i < 180)
    assert at == len(daily) == 280


@pytest.mark.parametrize("block_rows", [7, 300, 100_000])
def test_blocks_give_the_same_tables(spark, block_rows):
    closes = {"A": series(700, 1), "B": series(33, 2), "C": series(1, 3)}
    df, dim = silver(spark, closes, gap=3), sectors(spark, {"A": "x"})
    whole, blocks = gold.stock_features(df, dim), gold.stock_features(df, dim, block_rows)
    assert differences(blocks.toPandas(), whole.toPandas()) == []


@pytest.mark.parametrize("frames", [range(2, 40), [63, 64, 65, 127, 252, 256, 500, 999, 1000]])
def test_extremes_of_any_frame_equal_plain_python(spark, frames):
    rnd = random.Random(1)
    values = {"A": [rnd.choice([None, round(rnd.uniform(0, 9), 2)]) for _ in range(1100)], "B": [3.0]}
    rows = [(t, i, v) for t, vs in values.items() for i, v in enumerate(vs)]
    s = Series(["k"], "i")
    wanted = {f"{name}{n}": ("v", pick, n) for n in frames for name, pick in (("high", F.greatest), ("low", F.least))}
    out = s.extremes(spark.createDataFrame(rows, "k string, i int, v double"), wanted)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Sort [") == 1
    for r in out.collect():
        for n in frames:
            frame = [v for v in values[r.k][max(0, r.i - n + 1) : r.i + 1] if v is not None]
            assert (r[f"high{n}"], r[f"low{n}"]) == (max(frame, default=None), min(frame, default=None))


def test_deviations_equal_plain_python(spark):
    rnd = random.Random(2)
    values = {"A": [rnd.choice([None, round(rnd.uniform(-1e11, 1e11), 4), 0.0001]) for _ in range(200)], "B": [5.5] * 30, "C": [1e12 - 1, 1e12], "D": [2.0]}
    rows = [(t, i, v) for t, vs in values.items() for i, v in enumerate(vs)]
    s = Series(["k"], "i")
    out = spark.createDataFrame(rows, "k string, i int, v double").withColumns(s.squares("x", "v"))
    for r in out.withColumns({f"d{n}": s.deviation("x", n) for n in (2, 7, 90)}).collect():
        for n in (2, 7, 90):
            frame = [Decimal(repr(v)).quantize(Decimal("0.0001")) for v in values[r.k][max(0, r.i - n + 1) : r.i + 1] if v is not None]
            assert r[f"d{n}"] == (pytest.approx(float(statistics.stdev(frame)), rel=1e-12) if len(frame) > 1 else None)


def test_split_keeps_every_row_once_and_bounds_the_blocks(spark):
    df = silver(spark, {"A": series(1000, 1)})
    parts = split_series(df, "ticker_standard", "date", lookback=30, block_rows=100)
    own = parts.where(f"NOT {IS_HALO}")
    assert own.count() == own.select("date").distinct().count() == 1000
    largest = parts.groupBy(BLOCK).count().agg({"count": "max"}).first()[0]
    assert largest <= 100 + 31 + 30 + 2 * 31


def test_one_shuffle_per_series(spark, tmp_path):
    # A written mapping has a known size, below which it is broadcast.
    sectors(spark, {"A": "x"}).write.parquet(str(tmp_path / "sectors"))
    df, dim = silver(spark, {"A": series(30, 1)}), spark.read.parquet(str(tmp_path / "sectors"))
    for build in (gold.stock_daily_metrics, gold.stock_multitime_performance, gold.stock_technical_levels):
        plan = build(df, dim)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert plan.count("Sort [") == 1


def test_series_are_shuffled_as_they_are(spark, tmp_path):
    """The decimals that windows add up are made after the shuffle, not below it."""
    sectors(spark, {"A": "x"}).write.parquet(str(tmp_path / "sectors"))
    silver(spark, {"A": series(30, 1)}).write.parquet(str(tmp_path / "silver"))
    df, dim = (spark.read.parquet(str(tmp_path / t)) for t in ("silver", "sectors"))
    for build in (gold.stock_daily_metrics, gold.stock_multitime_performance, gold.stock_technical_levels):
        above, below = build(df, dim)._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
        assert "decimal" in above and "decimal" not in below


def test_bucketed_silver_needs_no_exchange(spark, tmp_path):
    sectors(spark, {"A": "x"}).write.parquet(str(tmp_path / "sectors"))
    df, dim = silver(spark, {"A": series(30, 1), "B": series(9, 2)}), spark.read.parquet(str(tmp_path / "sectors"))
    table = write_bucketed(df, "silver_in_buckets", str(tmp_path / "silver"), "ticker_standard", "date", 4)
    out = gold.stock_daily_metrics(table, dim)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Bucketed: true" in plan
    assert differences(out.toPandas(), gold.stock_daily_metrics(df, dim).toPandas()) == []
    # A join on the key of two tables in as many buckets needs none either.
    keys = write_bucketed(df.select("ticker_standard", "date").where("date = '2020-01-01'"), "keys_in_buckets", str(tmp_path / "keys"), "ticker_standard", "date", 4)
    joined = table.join(keys.drop("date").hint("merge"), "ticker_standard")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan and joined.count() == 39
    for name in ("silver_in_buckets", "keys_in_buckets"):
        spark.sql(f"DROP TABLE {name}")


def test_means_keep_the_digits_of_adjusted_prices(spark):
    closes = [101.00499999, 101.00500001, 98.76543210]
    df = silver(spark, {"A": closes[:2], "B": [closes[0], closes[0]], "C": closes})
    out = gold.stock_daily_metrics(df, sectors(spark, {"A": "x"}))
    last = {r.ticker_standard: r.ma_20 for r in out.orderBy("date").collect()}
    # A averages to exactly 101.005, B stays just below it.
    assert last == {"A": 101.01, "B": 101.0, "C": 100.26}
