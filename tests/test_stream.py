"""What a feed may bring that was not asked for, and what a run of the stream leaves behind."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tests.compare import differences
from tests.helpers import bar, bars
from tickframe.schemas import BAR_COLUMNS, BAR_SCHEMA
from tickframe.sinks import export_daily_json
from tickframe.streaming import ingest


def folders(tmp_path):
    return [str(tmp_path / n) for n in ("landing", "bronze", "checkpoint", "bad", "log")]


def spoil(landing, name, *lines):
    os.makedirs(f"{landing}/{name}", exist_ok=True)
    with open(f"{landing}/{name}/part.json", "w") as out:
        out.write("\n".join(lines) + "\n")


def test_broken_lines_go_to_quarantine_once(spark, tmp_path):
    landing, table, checkpoint, bad, _ = folders(tmp_path)
    rows = bars(spark, bar(day=0), bar("B", day=1)).select(*BAR_COLUMNS)
    export_daily_json(rows, landing)
    spoil(landing, "drop_date=2020-01-09", '{"ticker": "X", "date": ', "not json", '{"ticker": "C", "volume": "many"}')
    for _ in range(2):
        ingest.ingest_available(spark, landing, table, checkpoint, quarantine=bad)
    assert differences(spark.read.parquet(table).select(*BAR_COLUMNS).toPandas(), rows.toPandas()) == []
    texts = {r[ingest.CORRUPT] for r in spark.read.parquet(bad).collect()}
    assert texts == {'{"ticker": "X", "date": ', "not json", '{"ticker": "C", "volume": "many"}'}
    assert spark.read.parquet(bad).count() == 3


def test_run_says_what_it_committed(spark, tmp_path):
    landing, table, checkpoint, *_ = folders(tmp_path)
    assert ingest.committed(spark, table) == (0, 0)
    export_daily_json(bars(spark, bar(day=0), bar("B", day=1)).select(*BAR_COLUMNS), landing)
    first = ingest.ingest_available(spark, landing, table, checkpoint)
    export_daily_json(bars(spark, bar("C", day=2)).select(*BAR_COLUMNS), landing)
    second = ingest.ingest_available(spark, landing, table, checkpoint)
    nothing = ingest.ingest_available(spark, landing, table, checkpoint)
    assert [(x.rows_read, x.rows_written) for x in (first, second, nothing)] == [(2, 2), (1, 1), (0, 0)]
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(table) for f in files if f.endswith(".parquet"))
    assert first.bytes_written + second.bytes_written == size and ingest.committed(spark, table) == (3, size)
    # A file that no commit names, as a task that was tried again leaves, does not count.
    stray = next(os.path.join(d, f) for d, _, files in os.walk(table) for f in files if f.endswith(".parquet"))
    with open(stray, "rb") as source, open(os.path.join(os.path.dirname(stray), "part-stray.parquet"), "wb") as copy:
        copy.write(source.read())
    assert ingest.committed(spark, table) == (3, size)


def test_schema_log_takes_up_new_columns(spark, tmp_path):
    landing, table, checkpoint, _, log = folders(tmp_path)
    rows = bars(spark, bar(day=0)).select(*BAR_COLUMNS)
    export_daily_json(rows, landing)
    assert ingest.grown_schema(spark, landing, log) == BAR_SCHEMA
    ingest.ingest_available(spark, landing, table, checkpoint)
    assert ingest.grown_schema(spark, landing, log) == BAR_SCHEMA
    export_daily_json(bars(spark, bar(day=1)).select(*BAR_COLUMNS).withColumn("dividend", F.lit(0.5)), landing)
    wide = ingest.grown_schema(spark, landing, log)
    assert wide.fieldNames() == [*BAR_COLUMNS, "dividend"] and wide["dividend"].dataType.simpleString() == "double"
    ingest.ingest_available(spark, landing, table, checkpoint, schema=wide)
    export_daily_json(rows.limit(0), landing)
    assert ingest.grown_schema(spark, landing, log) == wide
    got = spark.read.option("mergeSchema", "true").parquet(table).orderBy("date").collect()
    assert [r.dividend for r in got] == [None, 0.5]


def test_a_batch_writes_few_files_a_day(spark, tmp_path):
    landing, table, checkpoint, *_ = folders(tmp_path)
    export_daily_json(bars(spark, *[bar(f"T{k}", day=k % 20) for k in range(200)]).repartition(8).select(*BAR_COLUMNS), landing)
    ingest.ingest_available(spark, landing, table, checkpoint)
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(table) for f in files) == 1
