"""Writers, upserts, streams and the lakehouse."""

from __future__ import annotations

import os
import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract
from tests.compare import differences
from tests.helpers import bar, bars, sectors
from tickframe import schemas
from tickframe.operators import dimensions
from tickframe.operators import upsert as upserts
from tickframe.operators.upsert import DuplicateSourceKeys, upsert, upsert_table
from tickframe.plans import monitor, screens
from tickframe.plans.lakehouse import FROM_DAILY, Lakehouse, refresh_silver, silver_bars
from tickframe.schemas import BAR_COLUMNS
from tickframe.sinks import append_audit, append_bars, clustered, export_daily_json, overwrite_partitions, write_bucketed, write_table
from tickframe.sources import bars as sources
from tickframe.sources import seed
from tickframe.streaming.ingest import ingest_available


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_upsert_updates_and_inserts_and_is_idempotent(spark):
    target, source = pairs(spark, [(1, "a"), (2, "b")]), pairs(spark, [(2, "B"), (3, "C")])
    once = upsert(target, source, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, upsert(once, source, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_upsert_adds_new_columns_and_refuses_ambiguous_sources(spark):
    target = pairs(spark, [(1, "a")])
    wider = upsert(target, pairs(spark, [(2, "b")]).withColumn("w", F.lit(9)), ["k"])
    assert sorted(map(tuple, wider.collect())) == [(1, "a", None), (2, "b", 9)]
    with pytest.raises(DuplicateSourceKeys):
        upsert(target, pairs(spark, [(2, "b"), (2, "c")]), ["k"])


def test_upsert_table_leaves_other_partitions_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, month string, v string"
    upsert_table(spark, path, spark.createDataFrame([(1, "m1", "a"), (2, "m2", "b")], schema), ["k"], "month", str(tmp_path / "s1"))
    before = {f for f in os.listdir(f"{path}/month=m1") if f.endswith(".parquet")}
    upsert_table(spark, path, spark.createDataFrame([(2, "m2", "B"), (3, "m3", "c")], schema), ["k"], "month", str(tmp_path / "s2"))
    got = sorted((r.k, r.month, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, "m1", "a"), (2, "m2", "B"), (3, "m3", "c")]
    assert {f for f in os.listdir(f"{path}/month=m1") if f.endswith(".parquet")} == before
    upsert_table(spark, path, spark.createDataFrame([], schema), ["k"], "month", str(tmp_path / "s3"))
    assert spark.read.parquet(path).count() == 3


def test_refresh_silver_in_two_steps_equals_one(spark, tmp_path):
    path = str(tmp_path / "silver")
    old = bars(spark, bar(day=0, rid="a"), bar(day=40, rid="b"))
    late = bars(spark, bar(day=40, close=9.5, hour=30, rid="c"), bar(day=70, rid="d")).withColumn(
        "ingestion_date", F.lit(date(2020, 6, 1))
    )
    refresh_silver(spark, old, path, str(tmp_path / "s1"), quarantine=str(tmp_path / "bad"))
    bad = bars(spark, bar(day=41, low=-1.0, rid="x"))
    refresh_silver(spark, bad, path, str(tmp_path / "s0"), quarantine=str(tmp_path / "bad"), at=datetime(2020, 3, 1))
    assert [r.record_id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["x"]
    refresh_silver(spark, old.unionByName(late), path, str(tmp_path / "s2"), since=date(2020, 6, 1))
    stepwise = spark.read.parquet(path).drop("month")
    assert differences(stepwise.toPandas(), silver_bars(old.unionByName(late)).toPandas()) == []
    refresh_silver(spark, late, path, str(tmp_path / "s3"))
    assert spark.read.parquet(path).count() == 3


def test_partitioned_writers(spark, tmp_path):
    path = str(tmp_path / "bars")
    append_bars(bars(spark, bar()), path)
    append_bars(bars(spark, bar(day=1)), path)
    assert spark.read.parquet(path).count() == 2
    table = str(tmp_path / "t")
    write_table(pairs(spark, [(1, "a"), (2, "b")]), table, ("k",))
    overwrite_partitions(pairs(spark, [(2, "z")]), table, ("k",))
    assert sorted((r.k, r.v) for r in spark.read.parquet(table).collect()) == [(1, "a"), (2, "z")]


def test_stream_picks_up_each_drop_once(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "checkpoint"))
    first = bars(spark, bar(day=0), bar("B", day=1, open=None)).select(*BAR_COLUMNS)
    export_daily_json(first, landing)
    assert len([d for d in os.listdir(landing) if d.startswith("drop_date=")]) == 2
    ingest_available(spark, landing, table, checkpoint)
    second = bars(spark, bar("C", day=2)).select(*BAR_COLUMNS)
    export_daily_json(second, landing)
    for _ in range(2):
        ingest_available(spark, landing, table, checkpoint)
    streamed = spark.read.parquet(table)
    assert streamed.where("processing_timestamp IS NULL").count() == 0
    expected = first.unionByName(second)
    assert differences(streamed.select(*BAR_COLUMNS).toPandas(), expected.toPandas()) == []
    assert differences(sources.read_json_bars(spark, landing).toPandas(), expected.toPandas()) == []


def test_stream_schema_can_grow(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "checkpoint"))
    old = bars(spark, bar(day=0)).select(*BAR_COLUMNS)
    export_daily_json(old, landing)
    ingest_available(spark, landing, table, checkpoint)
    wide = T.StructType([*schemas.BAR_SCHEMA.fields, T.StructField("dividend", T.DoubleType())])
    wider = bars(spark, bar(day=1)).select(*BAR_COLUMNS).withColumn("dividend", F.lit(0.5))
    export_daily_json(wider, landing)
    ingest_available(spark, landing, table, checkpoint, schema=wide)
    got = spark.read.option("mergeSchema", "true").parquet(table).orderBy("date").collect()
    assert [r.dividend for r in got] == [None, 0.5]


def test_normalise_keeps_known_columns(spark):
    at = datetime(2020, 1, 2, 3)
    vendor = spark.createDataFrame(
        [(datetime(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 10, 0.0)],
        "Date timestamp, Open double, High double, Low double, Close double, Volume long, Dividends double",
    )
    out = sources.normalise_bars(vendor, "api", at, ticker="AAA.NS")
    assert out.columns == BAR_COLUMNS
    row = out.first()
    assert (row.ticker, row.close, row.source, row.ingestion_timestamp, row.ingestion_date) == ("AAA.NS", 1.5, "api", at, at.date())
    assert sources.normalise_bars(vendor.drop("Volume"), "api", at, ticker="A").columns == [c for c in BAR_COLUMNS if c != "volume"]


def test_date_ranges(spark):
    assert sources.daily_range(date(2020, 1, 2)) == (date(2020, 1, 1), date(2020, 1, 2))
    assert sources.backfill_range(date(2020, 12, 30)) == (date(2016, 1, 1), date(2020, 12, 30))
    df = bars(spark, *[bar(day=d) for d in range(4)])
    assert sources.in_range(df, date(2020, 1, 2), date(2020, 1, 4)).count() == 2


def test_default_dimensions(spark):
    config, mapping = seed.default_config(spark, datetime(2024, 1, 1)), seed.default_sector_map(spark)
    assert config.count() == mapping.count() == 50
    assert config.select("sector").distinct().count() == 16
    assert mapping.select("sector").distinct().count() == 12
    joined = config.join(mapping, config.ticker_clean == mapping.ticker_standard)
    assert joined.where(config.sector != mapping.sector).count() == 8
    first = sources.universe(config).first()[0]
    assert first == "HDFCBANK.NS"
    assert seed.config_or_default(spark, "no_such_table", datetime(2024, 1, 1)).count() == 50


def test_dimension_maintenance(spark):
    at = datetime(2024, 5, 1)
    config = seed.default_config(spark, datetime(2024, 1, 1))
    off = dimensions.deactivate(config, "TCS.NS", at)
    assert sources.universe(off).count() == 49
    assert off.where("ticker_symbol = 'TCS.NS'").first().last_updated == at
    more = dimensions.add_tickers(off, spark.createDataFrame([(51, "X.NS", "X", "X Ltd", "Auto", True, at.date(), at)], schemas.TICKER_CONFIG))
    assert sources.universe(more).count() == 50
    assert dimensions.sector_map_from_config(more).count() == 50
    kept = sources.restrict_to_universe(bars(spark, bar("tcs.ns "), bar("infy.ns ")), more)
    assert [r.ticker for r in kept.collect()] == ["infy.ns "]


def test_unmapped_keys(spark):
    df = silver_bars(bars(spark, bar("A.NS"), bar("B.NS"), bar("B.NS", day=1)))
    assert [r[0] for r in dimensions.unmapped_keys(df, sectors(spark, {"A": "S"})).collect()] == ["B"]


def test_create_tables(spark, tmp_path):
    made = schemas.create_tables(spark, "audit_test")
    assert len(made) == 6
    described = {r.col_name: r for r in spark.sql("DESCRIBE audit_test.pipeline_runs").collect()}
    assert described["run_id"].comment == "run identifier"
    assert spark.table("audit_test.layer_metrics").schema.fieldNames()[-2:] == ["processing_date", "layer_name"]
    for name in made:
        spark.sql(f"DROP TABLE {name}")
    spark.sql("DROP DATABASE audit_test")


def test_audit_rows_append_with_null_messages(spark, tmp_path):
    at, path = datetime(2020, 1, 1), str(tmp_path / "metrics")
    for layer, rows in (("bronze", 3), ("silver", 2)):
        row = monitor.layer_profile(
            pairs(spark, [(i, "x") for i in range(rows)]), run_id="r1", layer=layer, table=f"{layer}.t", start=at, end=at
        )
        append_audit(row, path)
    failed = monitor.layer_profile(
        pairs(spark, []), run_id="r2", layer="gold", table="gold.t", start=at, end=datetime(2020, 1, 1, 0, 1),
        status="FAILED", error="boom",
    )
    append_audit(failed, path)
    metrics = spark.read.parquet(path)
    runs = {r.run_id: r for r in monitor.run_summary(metrics, run_name="n", run_type="FULL_LOAD", triggered_by="t").collect()}
    assert (runs["r1"].status, runs["r1"].error_message, runs["r1"].bronze_rows_in, runs["r1"].silver_rows_in) == ("SUCCESS", None, 3, 2)
    assert (runs["r2"].status, runs["r2"].error_message, runs["r2"].duration_seconds) == ("FAILED", "boom", 60.0)


@pytest.fixture(scope="module")
def history(spark):
    days = [d for d in range(400) if d % 7 < 5]
    rows = [
        bar(f"{t}.NS", d, 100.0, 103.0 + (d * k) % 17, 95.0, 102.0 + (d * k) % 17, 100 + (d * k) % 400, rid=f"{t}{d}")
        for k, t in enumerate("ABCDEFGHIJKL", 3)
        for d in days
    ]
    return bars(spark, *rows).repartition(4), sectors(spark, {t: "ST"[i % 2] for i, t in enumerate("ABCDEFGHIJK")})


def test_month_layout_and_split_series_change_no_result(spark, history, tmp_path):
    plain = Lakehouse(spark, *history, root=str(tmp_path / "plain"))
    scaled = Lakehouse(spark, *history, root=str(tmp_path / "scaled"), by_month=True, block_rows=50)
    for name in ("stock_daily_metrics", "stock_technical_levels", "stock_relative_strength", "market_overview_daily"):
        assert differences(scaled.gold(name).toPandas(), plain.gold(name).toPandas()) == []
        assert differences(scaled.plan(name).toPandas(), plain.gold(name).drop("month").toPandas()) == []
    assert os.path.isdir(f"{scaled.root}/gold.stock_features/month=2020-03-01")
    for screen, table in ((screens.bullish_alignment, "stock_daily_metrics"), (screens.at_year_high, "stock_technical_levels")):
        for when in (screens.LATEST, date(2020, 6, 3), screens.EACH_DAY):
            a, b = screen(scaled.gold(table), when).toPandas(), screen(plain.gold(table), when).toPandas()
            assert differences(a, b) == []
    assert screens.at_year_high(plain.gold("stock_technical_levels"), screens.EACH_DAY).count() > 0
    assert scaled.rows["silver.stock_prices_clean"] == scaled.silver.count()


def test_bronze_is_read_by_landing_period_and_hashed_ticker(spark, history, tmp_path):
    raw, dim = history
    raw = raw.withColumn("ingestion_date", F.trunc("date", "MM"))
    lake = Lakehouse(spark, raw, dim, root=str(tmp_path / "layout"))
    assert differences(lake.bronze.toPandas(), raw.toPandas()) == []
    assert os.path.isdir(f"{lake.root}/bronze.stock_prices_raw/ingestion_date=2020-03-01")
    some = sources.in_range(lake.bronze, date(2020, 3, 5), date(2020, 4, 7))
    assert "PartitionFilters: [((ingestion_date" in some._jdf.queryExecution().executedPlan().toString()
    assert differences(some.toPandas(), raw.where("date >= '2020-03-05' AND date < '2020-04-07'").toPandas()) == []
    config = spark.createDataFrame([("c.ns ", True), ("D.NS", False), (" ", True), (None, True)], "ticker_symbol string, is_active boolean")
    config.write.parquet(str(tmp_path / "config"))
    kept = sources.restrict_to_universe(lake.landed, spark.read.parquet(str(tmp_path / "config")))
    assert "dynamicpruning" in kept._jdf.queryExecution().executedPlan().toString()
    assert {r.ticker for r in kept.select("ticker").distinct().collect()} == {"C.NS"}


def test_unfinished_table_does_not_pass_for_one(spark, tmp_path):
    path = str(tmp_path / "half")
    pairs(spark, [(1, "a")]).write.parquet(path)
    assert upserts.read_if_exists(spark, path).count() == 1
    os.remove(f"{path}/_SUCCESS")
    assert upserts.read_if_exists(spark, path) is None


def test_latest_slice_reads_one_month(spark, history, tmp_path):
    lake = Lakehouse(spark, *history, root=str(tmp_path / "months"), by_month=True)
    newest = screens.latest_slice(lake.gold("stock_daily_metrics"))
    rows = newest.collect()
    assert {r.date for r in rows} == {lake.silver.agg(F.max("date")).first()[0]}
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_quarantine_table_keeps_the_rest(spark, tmp_path):
    raw = bars(spark, bar(), bar(day=1, low=-1.0))
    lake = Lakehouse(spark, raw, sectors(spark, {}), root=str(tmp_path / "q"))
    lake.build()
    assert lake.silver.count() == lake.quarantine.count() == 1
    audit = {r.table_name: r for r in lake.metrics("run").collect()}
    assert audit["silver.stock_prices_clean"].rows_read == 2
    assert audit["silver.stock_prices_quarantine"].rows_written == 1
    assert audit["gold.market_overview_daily"].rows_read == audit["gold.market_overview_daily"].rows_written == 1
    summary = monitor.run_summary(lake.metrics("run"), run_name="n", run_type="FULL_LOAD", triggered_by="t").first()
    assert (summary.status, summary.bronze_rows_in, summary.silver_rows_in) == ("SUCCESS", 2, 2)


def test_upsert_keeps_columns_of_either_side(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    narrow, wide = "k int, month string, v string", "k int, month string, v string, w int"
    for rows, schema in (([(1, "a", "x")], narrow), ([(2, "b", "y", 9)], wide), ([(3, "b", "z")], narrow)):
        upsert_table(spark, path, spark.createDataFrame(rows, schema), ["k"], "month", staging)
    got = spark.read.option("mergeSchema", "true").parquet(path).select("k", "month", "v", "w")
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", None), (2, "b", "y", 9), (3, "b", "z", None)]


def test_upsert_after_an_empty_first_load(spark, tmp_path):
    path, staging, schema = str(tmp_path / "t"), str(tmp_path / "s"), "k int, month string"
    upsert_table(spark, path, spark.createDataFrame([], schema), ["k"], "month", staging)
    upsert_table(spark, path, spark.createDataFrame([(1, "a")], schema), ["k"], "month", staging)
    assert spark.read.parquet(path).count() == 1


def test_interrupted_swap_is_finished(spark, tmp_path, monkeypatch):
    path, staging, schema = str(tmp_path / "t"), str(tmp_path / "s"), "k int, month string, v string"
    upsert_table(spark, path, spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], schema), ["k"], "month", staging)

    def lost(df, path, partitions):
        shutil.rmtree(f"{path}/month=a")
        raise RuntimeError("lost")

    monkeypatch.setattr(upserts, "overwrite_partitions", lost)
    with pytest.raises(RuntimeError):
        upsert_table(spark, path, spark.createDataFrame([(2, "a", "Y")], schema), ["k"], "month", staging)
    monkeypatch.undo()
    upsert_table(spark, path, spark.createDataFrame([(3, "b", "z")], schema), ["k"], "month", staging)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "Y"), (3, "z")]


def test_repeated_refresh_quarantines_once(spark, tmp_path):
    bad = bars(spark, bar(day=1, low=-1.0, rid="x"), bar(day=2, rid="y"))
    for _ in range(2):
        refresh_silver(spark, bad, str(tmp_path / "silver"), str(tmp_path / "s"), quarantine=str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert spark.read.parquet(str(tmp_path / "silver")).count() == 1


def test_both_layouts_have_the_same_columns(spark, history, tmp_path):
    lakes = [Lakehouse(spark, *history, root=str(tmp_path / str(m)), by_month=m) for m in (False, True)]
    for name in ("stock_daily_metrics", "stock_relative_strength", "sector_daily_metrics"):
        assert lakes[0].gold(name).columns == lakes[1].gold(name).columns
    assert lakes[0].silver.columns == lakes[1].silver.columns


def test_existing_lake_is_read_unless_rebuilt(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert Lakehouse(spark, bars(spark, bar(), bar(day=1)), sectors(spark, {}), root=root).silver.count() == 2
    assert Lakehouse(spark, bars(spark, bar()), sectors(spark, {}), root=root).silver.count() == 2
    assert Lakehouse(spark, bars(spark, bar()), sectors(spark, {}), root=root, rebuild=True).silver.count() == 1


def test_failed_step_is_in_the_audit_rows(spark, tmp_path):
    lake = Lakehouse(spark, bars(spark, bar()).drop("close"), sectors(spark, {}), root=str(tmp_path / "f"))
    with pytest.raises(Exception):
        lake.silver
    rows = {r.table_name: r.status for r in lake.metrics("r").collect()}
    assert rows == {"bronze.stock_prices_raw": "SUCCESS", "silver.stock_prices_clean": "FAILED"}


def test_odd_numbers_go_to_quarantine(spark, tmp_path):
    inf = float("inf")
    odd = [bar(day=1, high=inf, close=inf), bar(day=2, open=1e-12, high=2e6, low=1e-12, close=1e6), bar(day=3, volume=2 * 10**18),
           bar(day=4, open=1e17, high=1e17, low=1e17, close=1e17), bar(day=5)]
    lake = Lakehouse(spark, bars(spark, *odd), sectors(spark, {}), root=str(tmp_path / "odd"))
    lake.build()
    reasons = {r.date.day: r.failure_reasons for r in lake.quarantine.collect()}
    assert lake.silver.count() == 1 and reasons[3] == reasons[4] == reasons[5] == ["values_in_range"]
    assert "no_null_critical_fields" in reasons[2]


def test_latest_bar_does_not_depend_on_row_order(spark):
    rows = [bar(close=10.0), bar(close=11.0), bar(close=10.5)]
    for order in (rows, rows[::-1]):
        assert silver_bars(bars(spark, *order).drop("record_id")).first().close == 11.0


def test_one_table_is_written_with_its_own_columns(spark, history, tmp_path):
    lake = Lakehouse(spark, *history, root=str(tmp_path / "own"))
    lake.gold("market_overview_daily")
    assert sorted(t for t in os.listdir(lake.root) if t.startswith("gold.stock")) == ["gold.stock_daily_metrics"]
    read = {r.table_name: r.rows_read for r in lake.metrics("r").collect()}
    assert read["gold.market_overview_daily"] == lake.rows["gold.stock_daily_metrics"] == read["gold.stock_daily_metrics"]
    whole = Lakehouse(spark, *history, root=str(tmp_path / "whole"))
    whole.build()
    assert not os.path.exists(f"{whole.root}/gold.stock_daily_metrics")
    for name in ("stock_daily_metrics", "stock_technical_levels", "market_overview_daily"):
        assert differences(lake.gold(name).toPandas(), whole.gold(name).toPandas()) == []


def test_merged_rows_are_staged_as_they_are(spark, tmp_path, monkeypatch):
    path, staging, schema = str(tmp_path / "t"), str(tmp_path / "s"), "k int, month string, v string"
    upsert_table(spark, path, spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema), ["k"], "month", staging)
    upsert_table(spark, path, spark.createDataFrame([(2, "b", "Y"), (3, None, "z")], schema), ["k"], "month", staging)
    assert not [d for d in os.listdir(f"{staging}/source") if d.startswith("month=")]
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "Y"), (3, "z")]


def test_daily_drops_are_compressed(spark, tmp_path):
    landing = str(tmp_path / "landing")
    export_daily_json(bars(spark, bar(day=0)).select(*BAR_COLUMNS), landing)
    assert {f.rsplit(".", 1)[1] for f in os.listdir(f"{landing}/drop_date=2020-01-01") if f.startswith("part-")} == {"gz"}


def test_clustering_stays_within_the_shuffle_that_does_not_sort(spark, tmp_path):
    """Beyond the bypass threshold a map task would hold, and spill, all the rows it deals out."""
    rows, path = spark.range(50).selectExpr("id % 5 AS k", "id"), str(tmp_path / "t")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for wanted, used in (("1000", 200), ("7", 7)):
            spark.conf.set("spark.sql.shuffle.partitions", wanted)
            plan = clustered(rows, ("k",))._jdf.queryExecution().executedPlan().toString()
            assert f", {used}), REBALANCE_PARTITIONS_BY_COL" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    write_table(rows, path, ("k",))
    assert sorted((r.id, r.k) for r in spark.read.parquet(path).collect()) == [(i, i % 5) for i in range(50)]


def test_normalised_bars_look_up_supplier_and_nation(spark, tmp_path):
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    items = [(k, 1, supplier, 1, 2.0, 20.0, 0.05, 0.0, datetime(2000, 1, 3)) for k, supplier in enumerate((5, 6, 5, 7, 8), 1)]
    tables = {
        "lineitem": spark.createDataFrame(items, columns),
        # Of the five line items' suppliers one has no nation, and one is not known.
        "supplier": spark.createDataFrame([(5, 1), (6, 2), (7, 9)], "s_suppkey long, s_nationkey int"),
        "nation": spark.createDataFrame([(1, "PERU"), (2, "KENYA")], "n_nationkey int, n_name string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = contract.queries()["bars_normalised"](spark, str(tmp_path)).collect()
    assert sorted(r.ticker for r in got) == ["kenya.ns ", "peru.ns ", "peru.ns "] and {r.source for r in got} == {"vendor"}
    # 2 924 days after the first of 1992: prices of nations with an even number rise with them, the others fall.
    assert {r.ticker: r.open for r in got} == {"peru.ns ": 10.0 + 1000 * (3700 - 2924), "kenya.ns ": 10.0 + 1000 * 2924}


def test_repeated_refresh_moves_no_row_of_the_table(spark, tmp_path, monkeypatch):
    """The second refresh replaces every bar: only keys are compared, and no copy of all flagged bars is staged."""
    days = bars(spark, *[bar(t, d, rid=f"{t}{d}") for t in ("A.NS", "B.NS") for d in range(70)], bar(day=3, low=-1.0, rid="x"))
    path, staging, plans = str(tmp_path / "silver"), str(tmp_path / "s"), []
    write = upserts.write_table
    monkeypatch.setattr(upserts, "clustered", lambda df, columns: pytest.fail("silver's rows are written where they are"))
    monkeypatch.setattr(upserts, "write_table", lambda df, to, *a, **k: (plans.append((to, df)), write(df, to, *a, **k)))
    for _ in range(2):
        refresh_silver(spark, days, path, staging, quarantine=str(tmp_path / "bad"))
    kept = next(df for to, df in plans if to.endswith("/kept"))
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 0
    assert not os.path.exists(f"{staging}/flagged") and not os.path.exists(f"{staging}/kept")
    assert differences(spark.read.parquet(path).drop("month").toPandas(), silver_bars(days).toPandas()) == []


@pytest.mark.parametrize("replaced", [(1,), (1, 2, 3, 4), (None, 1, 2, 3, 4, 5), ()])
def test_rows_without_a_source_key_are_kept(spark, tmp_path, replaced):
    """Whichever keys are the fewer: rows with a NULL key match nothing, repeated ones stay repeated."""
    rows = [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (5, "f"), (None, "g")]
    staged = lambda df, name: (write_table(df, f"{tmp_path}/{name}"), spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}"))[1]
    source = spark.createDataFrame([(k,) for k in replaced], "k int")
    got = upserts._without(pairs(spark, rows), source, ["k"], staged).collect()
    assert sorted(r.v for r in got) == [v for k, v in rows if k is None or k not in replaced]


def test_lake_of_some_tables_has_their_columns(spark, history, tmp_path, monkeypatch):
    """Refreshed tables equal rebuilt ones; of all rows only bronze is clustered, the rest is written where it is."""
    raw, dim = history
    raw = raw.withColumn("ingestion_date", F.trunc("date", "MM"))
    whole, dealt = Lakehouse(spark, raw, dim, root=str(tmp_path / "whole"), by_month=True), []
    monkeypatch.setattr("tickframe.sinks.clustered", lambda df, columns: (dealt.append(tuple(columns)), clustered(df, columns))[1])
    late = F.col("ingestion_date") == F.lit(date(2020, 6, 1))
    for name, width in (("stock_relative_strength", 0), ("stock_multitime_performance", 13), ("sector_daily_metrics", 10)):
        dealt.clear()
        lake = Lakehouse(spark, raw.where(~late), dim, root=str(tmp_path / name), by_month=True, only=[name])
        lake.refresh(raw.where(late))
        assert set(dealt) <= {("ingestion_date", "ticker_bucket"), ("month",)} and (("month",) in dealt) == (name in FROM_DAILY)
        features = f"{lake.root}/gold.stock_features"
        assert (len(spark.read.parquet(features).columns) - 1 if os.path.isdir(features) else 0) == width
        assert differences(lake.gold(name).toPandas(), whole.gold(name).toPandas()) == [], name
        with pytest.raises(ValueError):
            lake.gold("stock_daily_metrics")
    with pytest.raises(ValueError):
        Lakehouse(spark, raw, dim, only=["top_movers_daily"])


def test_silver_goes_into_buckets_by_one_shuffle(spark, tmp_path):
    raw = bars(spark, *[bar(f"{t}.NS", d, close=11.0 + h / 100, hour=18 + h, rid=f"{t}{d}{h}") for t in "ABCDE" for d in range(20) for h in range(2)])
    dealt = silver_bars(raw, buckets=3)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    table = write_bucketed(dealt, "silver_dealt", str(tmp_path / "silver"), "ticker_standard", "date", 3, dealt=True)
    parts = [f for f in os.listdir(tmp_path / "silver") if f.startswith("part-")]
    assert len(parts) == len({f.rsplit("_", 1)[1] for f in parts}) <= 3
    assert differences(table.toPandas(), silver_bars(raw).toPandas()) == []
    spark.sql("DROP TABLE silver_dealt")


def test_buckets_follow_the_bars(spark, monkeypatch):
    counts = []
    monkeypatch.setattr(contract, "BUCKET_ROWS", 500)
    monkeypatch.setattr(contract, "write_bucketed", lambda *a, **k: (counts.append(k["buckets"]), write_bucketed(*a, **k))[1])
    contract.queries()["stock_daily_metrics_bucketed"](spark, "/root/testdata/sf0.001").count()
    assert counts == [contract.lake(spark, "/root/testdata/sf0.001").bronze.count() // 500]
