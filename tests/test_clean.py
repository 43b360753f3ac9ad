from __future__ import annotations

import math
from datetime import date, datetime

from pyspark.sql import functions as F

from tests.helpers import bar, bars, rows_by
from tickframe.operators.clean import clean, duplicate_keys, gap_report, keep_latest, trading_date
from tickframe.operators.quality import RuleSet, bar_rules
from tickframe.plans.lakehouse import quarantined_bars, silver_bars


def test_ticker_is_trimmed_upper_cased_and_stripped_of_its_suffix(spark):
    out = clean(bars(spark, bar(" abc.ns "), bar("NS.X", day=1))).select("ticker_standard").collect()
    assert [r[0] for r in out] == ["ABC", "NS.X"]


def test_return_on_zero_or_missing_open_is_null(spark):
    got = rows_by(clean(bars(spark, bar(open=0.0, rid="z"), bar(open=None, rid="n"), bar(rid="ok"))), "record_id")
    assert got["z"].daily_return_pct is None
    assert got["n"].daily_return_pct is None
    assert got["ok"].daily_return_pct == 10.0


def test_nan_and_text_become_null(spark):
    raw = bars(spark, bar(close=math.nan, rid="nan"))
    assert clean(raw).first().close is None
    text = raw.withColumn("open", F.lit("n/a")).withColumn("volume", F.lit(math.nan))
    row = clean(text).first()
    assert row.open is None and row.volume is None


def test_weekend_flag(spark):
    # 2020-01-04 is a Saturday.
    got = clean(bars(spark, *[bar(day=d) for d in range(3, 6)])).orderBy("date").select("is_trading_day").collect()
    assert [r[0] for r in got] == [False, False, True]
    missing = clean(bars(spark, bar()).withColumn("date", F.lit(None).cast("timestamp")))
    assert missing.first().is_trading_day is True


def test_trading_date_in_exchange_time(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 18, 30),)], "date timestamp")
    row = df.select(trading_date("date"), trading_date("date", "Asia/Kolkata")).first()
    assert row[0] == date(2020, 1, 1) and row[1] == date(2020, 1, 2)


def test_keep_latest_breaks_ties_by_record(spark):
    raw = bars(spark, bar(hour=18, rid="a"), bar(hour=19, rid="b"), bar(hour=19, rid="c"), bar("B", rid="d"))
    kept = keep_latest(clean(raw)).select("record_id").collect()
    assert sorted(r[0] for r in kept) == ["c", "d"]


def test_keep_latest_limits_groups_before_the_shuffle(spark):
    plan = keep_latest(clean(bars(spark, bar())))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_duplicate_keys(spark):
    out = duplicate_keys(clean(bars(spark, bar(rid="a"), bar(rid="b"), bar(day=1)))).collect()
    assert len(out) == 1 and out[0]["count"] == 2


def test_gaps_of_more_than_three_days(spark):
    raw = clean(bars(spark, *[bar(day=d) for d in (0, 3, 7, 8)], bar("B", day=100)))
    out = gap_report(raw).collect()
    assert [(r.days_gap, r.prev_date) for r in out] == [(4, date(2020, 1, 4))]


def test_every_bar_is_either_valid_or_quarantined(spark):
    raw = bars(
        spark, bar(rid="ok"), bar(open=None, day=1, rid="no-open"), bar(low=-1.0, day=2, rid="neg"),
        bar(high=1.0, day=3, rid="high"), bar(volume=None, day=4, rid="no-vol"), bar(close=None, day=5, rid="no-close"),
    )
    good, bad = silver_bars(raw), rows_by(quarantined_bars(raw), "record_id")
    assert [r.record_id for r in good.collect()] == ["ok"]
    assert set(bad) == {"no-open", "neg", "high", "no-vol", "no-close"}
    assert bad["neg"].failure_reasons == ["no_negative_prices"]
    assert bad["no-vol"].failure_reasons == ["non_negative_volume"]
    assert bad["no-close"].failure_reasons == [
        "no_negative_prices", "high_is_highest", "low_is_lowest", "no_null_critical_fields",
    ]
    assert set(bad["high"].failure_reasons) == {"high_is_highest", "low_is_lowest"}
    low = {"low": ["low_is_lowest"]}
    assert rows_by(quarantined_bars(bars(spark, bar(low=10.5, rid="low"))), "record_id")["low"].failure_reasons == low["low"]


def test_derived_columns_are_not_shuffled_to_find_the_latest(spark):
    raw = bars(spark, bar(close=10.5, rid="r1"), bar(close=11.0, rid="r2"), bar(low=-1.0, day=1))
    out = silver_bars(raw)
    below = out._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]
    assert not any(c in below for c in ("daily_return_pct", "price_range", "is_trading_day"))
    want = keep_latest(RuleSet(bar_rules()).valid(clean(raw)))
    assert out.columns == want.columns and out.collect() == want.collect()
    assert out.first().daily_return_pct == 10.0
