from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.helpers import bar, bars, silver
from tickframe.functions import distinct
from tickframe.plans import gold, profiles
from tickframe.staging import stored


def test_bitmaps_count_and_merge_exactly(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.choice([None, *range(0, 300, 7), 10**12])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v long")
    parts = [distinct.words(df.where(f"v % 2 = {k}"), ["k"], F.col("v")) for k in (0, 1)]
    got = {r.k: r.n for r in distinct.counts(distinct.merged(parts, ["k"]), ["k"], "n").collect()}
    assert got == {k: len({v for a, v in rows if a == k and v is not None}) for k in "ab"}
    assert distinct.counts(distinct.words(df.limit(0), ["k"], F.col("v")), ["k"], "n").count() == 0


def test_dictionary_keeps_known_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    first = stored(distinct.dictionary(df, "t", stored))
    assert {r.t: r.code for r in first.collect()} == {"a": 0, "b": 1}
    more = distinct.dictionary(spark.createDataFrame([("0",), ("b",), ("z",)], "t string"), "t", stored, first)
    assert {r.t: r.code for r in more.collect()} == {"a": 0, "b": 1, "0": 2, "z": 3}


def test_profiles_of_periods_merge(spark):
    df = bars(spark, *[bar(t, day=d) for d in range(60) for t in ("A", "B") if d < 31 or t == "A"], bar("C", day=59))
    df = df.withColumn("ingestion_date", F.trunc("date", "MM"))
    codes = stored(distinct.dictionary(df, "ticker", stored))
    parts = stored(profiles.period_profiles(df.where("date < '2020-02-01'"), codes).unionByName(profiles.period_profiles(df.where("date >= '2020-02-01'"), codes)))
    assert profiles.merged_profile(parts, "x").first() == profiles.source_profile(df, "x").first()
    assert profiles.merged_profile(parts.limit(0), "x").first().unique_tickers == 0


def test_market_overview_sends_no_row_per_sector(spark):
    daily = gold.stock_daily_metrics(silver(spark, {"A": [1.0, 2.0]}), spark.createDataFrame([("A", "S")], "ticker_standard string, sector string"))
    plan = gold.market_overview_daily(daily)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan
