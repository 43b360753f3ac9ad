from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import bar, bars
from tickframe.operators.clean import clean
from tickframe.operators.quality import RuleSet, bar_rules, duplicate_check, freshness_check, null_check
from tickframe.schemas import DATA_FRESHNESS, DATA_QUALITY_CHECKS

AS_OF = datetime(2020, 1, 3)
TAGS = {"run_id": "r", "layer": "bronze", "table": "bronze.t", "as_of": AS_OF}


def numbers(spark, nulls: int, total: int):
    return spark.createDataFrame([(None if i < nulls else i,) for i in range(total)], "a int")


@pytest.mark.parametrize("nulls, result", [(4, "PASS"), (5, "WARNING"), (6, "FAIL")])
def test_null_check_grades(spark, nulls, result):
    # Of 100 rows, 5 % is tolerated and more than 4 % is a warning.
    row = null_check(numbers(spark, nulls, 100), ["a"], 0.05, **TAGS).first()
    assert (row.check_result, row.records_failed, row.failure_rate) == (result, nulls, pytest.approx(nulls))
    assert json.loads(row.check_details) == {"column": "a", "null_count": nulls, "null_rate": nulls / 100}


def test_null_check_is_one_pass(spark):
    df = numbers(spark, 1, 10).selectExpr("a", "a AS b", "a AS c")
    out = null_check(df, ["a", "b", "c"], **TAGS)
    assert out.count() == 3 and out.schema.fieldNames() == DATA_QUALITY_CHECKS.fieldNames()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_checks_on_an_empty_table_pass(spark):
    empty = bars(spark, bar()).where("false")
    for row in (null_check(empty, ["close"], **TAGS).first(), duplicate_check(empty, ["ticker", "date"], **TAGS).first()):
        assert (row.check_result, row.records_checked, row.failure_rate) == ("PASS", 0, 0.0)
    fresh = freshness_check(empty, layer="bronze", table="bronze.t", as_of=AS_OF).first()
    assert fresh.is_fresh is False and fresh.data_latency_hours is None and fresh.record_count == 0


def test_duplicate_check_counts_every_copy(spark):
    df = bars(spark, bar(rid="a"), bar(rid="b"), bar(rid="c"), bar(day=1))
    row = duplicate_check(df, ["ticker", "date"], 0.01, **TAGS).first()
    assert (row.records_checked, row.records_failed, row.failure_rate, row.check_result) == (4, 3, 75.0, "FAIL")
    assert json.loads(row.check_details) == {"key_columns": ["ticker", "date"], "duplicate_count": 3}


@pytest.mark.parametrize("sla, fresh", [(48, True), (47.9, False)])
def test_freshness_against_the_target(spark, sla, fresh):
    out = freshness_check(bars(spark, bar()), sla_hours=sla, layer="bronze", table="bronze.t", as_of=AS_OF)
    row = out.first()
    assert (row.data_latency_hours, row.is_fresh) == (48.0, fresh)
    assert row.latest_ingestion_time == datetime(2020, 1, 1, 18)
    assert out.schema.fieldNames() == DATA_FRESHNESS.fieldNames()


def test_rule_summary(spark):
    df = clean(bars(spark, bar(), bar(day=1, volume=-5), bar(day=2, open=None)))
    row = RuleSet(bar_rules()).summary(df).first()
    assert (row.total_records, row.valid_records, row.quarantined_records, row.valid_pct) == (3, 1, 2, 33.33)
    assert row.pass_non_negative_volume == 2 and row.pass_no_negative_prices == 2
    empty = RuleSet(bar_rules()).summary(df.where("false")).first()
    assert empty.total_records == 0 and empty.valid_pct is None


def test_a_walk_scans_each_table_once(spark, tmp_path):
    from tickframe.plans.monitor import monitored_walk

    tables = []
    for name in ("bronze", "silver", "gold"):
        bars(spark, bar(), bar(rid="b"), bar(day=1, close=None)).withColumn("ticker_standard", F.upper("ticker")).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    walk = monitored_walk(*tables, run_id="r", as_of=AS_OF)
    for name, rows in (("metrics", 3), ("checks", 6), ("freshness", 3)):
        plan = walk[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == (2 if name == "checks" else 3), name
        assert walk[name].count() == rows
    failed = {(r.layer_name, r.check_name): r.records_failed for r in walk["checks"].collect()}
    assert failed["bronze", "Null Check: close"] == 1 and failed["bronze", "Duplicate Check: ticker, date"] == 2
