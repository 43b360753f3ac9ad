"""Row rules with quarantine, and one-pass table checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.numeric import count_where, ratio
from tickframe.schemas import DATA_FRESHNESS, DATA_QUALITY_CHECKS

PRICES = ("open", "high", "low", "close")

# Share of a threshold from which a passing check is reported as a warning.
WARNING_SHARE = 0.8


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Column

    @property
    def column(self) -> str:
        return f"check_{self.name}"


def all_of(conditions) -> Column:
    return reduce(and_, conditions)


# What the exact decimals of the gold tables hold with room to sum.
MAX_PRICE, MAX_VOLUME, MAX_CHANGE = 1e12, 1e15, 1e9


def _in_range() -> list[Column]:
    """Missing values are for the other rules."""
    change = F.abs(F.try_divide(F.col("close"), F.col("open")))
    limits = [(F.col(p), MAX_PRICE) for p in PRICES] + [(F.col("volume"), MAX_VOLUME), (change, MAX_CHANGE)]
    return [F.coalesce(value <= limit, F.lit(True)) for value, limit in limits]


def bar_rules() -> list[Rule]:
    """Rules a price bar must meet to enter silver."""
    high, low = F.col("high"), F.col("low")
    return [
        Rule("no_negative_prices", all_of(F.col(p) >= 0 for p in PRICES)),
        Rule("high_is_highest", all_of(high >= F.col(p) for p in ("low", "close", "open"))),
        Rule("low_is_lowest", all_of(low <= F.col(p) for p in ("high", "close", "open"))),
        Rule("non_negative_volume", F.col("volume") >= 0),
        Rule("no_null_critical_fields", all_of(F.col(c).isNotNull() for c in ("ticker", "date", "close"))),
        Rule("values_in_range", all_of(_in_range())),
    ]


@dataclass(frozen=True)
class RuleSet:
    """Named conditions; an unknown (NULL) outcome counts as a failure."""

    rules: Sequence[Rule]

    def flag(self, df: DataFrame) -> DataFrame:
        checked = df.withColumns({r.column: F.coalesce(r.condition, F.lit(False)) for r in self.rules})
        reasons = F.array(*[F.when(~F.col(r.column), r.name) for r in self.rules])
        return checked.withColumns(
            {
                "is_valid": all_of(F.col(r.column) for r in self.rules),
                "failure_reasons": F.array_compact(reasons),
            }
        )

    def valid(self, df: DataFrame) -> DataFrame:
        helpers = [r.column for r in self.rules]
        return self.flag(df).where("is_valid").drop(*helpers, "is_valid", "failure_reasons")

    def quarantined(self, df: DataFrame, at: datetime | None = None) -> DataFrame:
        stamp = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        return self.flag(df).where(~F.col("is_valid")).withColumn("quarantine_timestamp", stamp)

    def split(self, df: DataFrame, at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
        return self.valid(df), self.quarantined(df, at)

    def summary(self, df: DataFrame) -> DataFrame:
        """Rows, passes per rule and valid share in one pass."""
        flagged = self.flag(df)
        passes = [count_where(F.col(r.column)).alias(f"pass_{r.name}") for r in self.rules]
        valid, total = count_where(F.col("is_valid")), F.count(F.lit(1))
        return flagged.agg(
            total.alias("total_records"),
            valid.alias("valid_records"),
            (total - valid).alias("quarantined_records"),
            F.round(ratio(valid, total) * 100, 2).alias("valid_pct"),
            *passes,
        )


def grade(rate: Column, threshold: float | Column) -> Column:
    return (
        F.when(rate > threshold, "FAIL")
        .when(rate > threshold * WARNING_SHARE, "WARNING")
        .otherwise("PASS")
    )


def table_stats(df: DataFrame, nulls: Sequence[str] = (), keys: Sequence[str] = (), date_col: str | None = None) -> DataFrame:
    """One row with all that the checks of a table need, from one scan.

    ``records``; ``null_counts``, a map by column; ``duplicates``, the rows whose key occurs more than once; ``oldest`` and
    ``newest`` day and the last landing time ``landed``. With ``keys`` the rows are counted by key first, and everything
    else is carried along in that aggregate; without, one aggregate does.
    """
    day = F.lit(None).cast("timestamp") if date_col is None else F.col(date_col).cast("timestamp")
    landed = F.col("ingestion_timestamp") if "ingestion_timestamp" in df.columns else F.lit(None).cast("timestamp")
    first = {
        "records": F.count(F.lit(1)), **{f"_null_{i}": count_where(F.col(c).isNull()) for i, c in enumerate(nulls)},
        "oldest": F.min(day), "newest": F.max(day), "landed": F.max(landed),
    }
    if keys:
        whole = {name: F.min if name == "oldest" else F.max if name in ("newest", "landed") else F.sum for name in first}
        copies = F.sum(F.when(F.col("records") > 1, F.col("records"))).alias("duplicates")
        by_key = df.groupBy(*keys).agg(*[c.alias(name) for name, c in first.items()])
        stats = by_key.agg(*[pick(name).alias(name) for name, pick in whole.items()], copies)
    else:
        stats = df.agg(*[c.alias(name) for name, c in first.items()], F.lit(0).cast("long").alias("duplicates"))
    counts = [F.coalesce(F.col(f"_null_{i}"), F.lit(0)) for i in range(len(nulls))]
    by_column = F.map_from_arrays(F.array(*[F.lit(c) for c in nulls]).cast("array<string>"), F.array(*counts).cast("array<bigint>"))
    return stats.select(
        F.coalesce("records", F.lit(0)).alias("records"), by_column.alias("null_counts"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
        "oldest", "newest", "landed",
    )


def _entry(check_type: str, title: str, slug: str, threshold: float, failed: Column, details: Column) -> Column:
    return F.struct(
        F.lit(check_type).alias("type"), F.lit(title).alias("title"), F.lit(slug).alias("slug"), F.lit(float(threshold)).alias("threshold"),
        failed.cast("long").alias("failed"), details.alias("details"),
    )


def _null_entries(columns: Sequence[str], threshold: float) -> list[Column]:
    out = []
    for name in columns:
        failed = F.col("null_counts")[name]
        share = F.coalesce(ratio(failed, "records"), F.lit(0.0)).cast("decimal(10,4)")
        details = F.to_json(F.struct(F.lit(name).alias("column"), failed.alias("null_count"), share.alias("null_rate")))
        out.append(_entry("NULL_CHECK", f"Null Check: {name}", f"null:{name}", threshold, failed, details))
    return out


def _duplicate_entry(keys: Sequence[str], threshold: float) -> Column:
    details = F.to_json(F.struct(F.array(*[F.lit(k) for k in keys]).alias("key_columns"), F.col("duplicates").alias("duplicate_count")))
    return _entry("DUPLICATE_CHECK", "Duplicate Check: " + ", ".join(keys), "duplicate:" + ",".join(keys), threshold, F.col("duplicates"), details)


def _check_rows(stats: DataFrame, entries: Sequence[Column], *, run_id: str, layer: str, table: str, as_of: datetime) -> DataFrame:
    """Audit rows of checks, an entry each, from one row of ``table_stats``."""
    rate = F.coalesce(ratio("failed", "records"), F.lit(0.0))
    values = {
        "check_id": F.concat_ws(":", F.lit(run_id), F.lit(table), "slug"),
        "run_id": F.lit(run_id),
        "layer_name": F.lit(layer),
        "table_name": F.lit(table),
        "check_name": F.col("title"),
        "check_type": F.col("type"),
        "check_result": grade(rate, F.col("threshold")),
        "records_checked": F.col("records"),
        "records_failed": F.col("failed"),
        "failure_rate": rate * 100,
        "threshold": F.col("threshold") * 100,
        "check_details": F.col("details"),
        "checked_at": F.lit(as_of),
        "processing_date": F.lit(as_of.date()),
        "created_at": F.lit(as_of),
    }
    checks = stats.select("records", F.inline(F.array(*entries)))
    return checks.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in DATA_QUALITY_CHECKS])


def null_check(df: DataFrame, columns: Sequence[str], threshold: float = 0.05, **where) -> DataFrame:
    """Share of NULLs per column; all columns are counted in one pass."""
    return _check_rows(table_stats(df, nulls=columns), _null_entries(columns, threshold), **where)


def duplicate_check(df: DataFrame, keys: Sequence[str], threshold: float = 0.01, **where) -> DataFrame:
    """Share of rows whose key occurs more than once, all copies counted."""
    return _check_rows(table_stats(df, keys=keys), [_duplicate_entry(keys, threshold)], **where)


def freshness_rows(stats: DataFrame, sla_hours: float, *, layer: str, table: str, as_of: datetime) -> DataFrame:
    """Freshness row from ``table_stats`` of a date column; a table without landing times counts as landed when checked."""
    now = F.lit(as_of).cast("timestamp")
    hours = (F.unix_micros(now) - F.unix_micros("newest")) / 3600e6
    values = {
        "freshness_id": F.concat_ws(":", F.lit(table), F.lit(as_of.isoformat())),
        "table_name": F.lit(table),
        "layer_name": F.lit(layer),
        "latest_data_date": F.col("newest"),
        "latest_ingestion_time": F.col("landed"),
        "current_check_time": now,
        "data_latency_hours": hours,
        "is_fresh": F.coalesce(hours <= sla_hours, F.lit(False)),
        "freshness_sla_hours": F.lit(float(sla_hours)),
        "record_count": F.col("records"),
        "min_date": F.col("oldest"),
        "max_date": F.col("newest"),
        "checked_at": now,
        "created_at": now,
    }
    return stats.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in DATA_FRESHNESS])


def _landing(df: DataFrame, stats: DataFrame, as_of: datetime) -> DataFrame:
    """Tables without landing times, such as derived ones, have landed when they are checked."""
    if "ingestion_timestamp" in df.columns:
        return stats
    return stats.withColumn("landed", F.when(F.col("records") > 0, F.lit(as_of).cast("timestamp")))


def freshness_check(
    df: DataFrame, date_col: str = "date", sla_hours: float = 24, *, layer: str, table: str, as_of: datetime,
) -> DataFrame:
    """Age of the newest data against a target; an empty table is never fresh."""
    stats = _landing(df, table_stats(df, date_col=date_col), as_of)
    return freshness_rows(stats, sla_hours, layer=layer, table=table, as_of=as_of)


@dataclass(frozen=True)
class TableChecks:
    """What is checked of one table: NULLs by column, repeated keys, and the age of its newest day."""

    layer: str
    table: str
    nulls: Sequence[str] = ()
    null_threshold: float = 0.05
    keys: Sequence[str] = ()
    duplicate_threshold: float = 0.01
    date_col: str = "date"
    sla_hours: float = 24

    def stats(self, df: DataFrame, as_of: datetime) -> DataFrame:
        """All counts of the table, from one scan."""
        return _landing(df, table_stats(df, self.nulls, self.keys, self.date_col), as_of)

    def checks(self, stats: DataFrame, run_id: str, as_of: datetime) -> DataFrame | None:
        entries = [*_null_entries(self.nulls, self.null_threshold), *([_duplicate_entry(self.keys, self.duplicate_threshold)] if self.keys else [])]
        return _check_rows(stats, entries, run_id=run_id, layer=self.layer, table=self.table, as_of=as_of) if entries else None

    def freshness(self, stats: DataFrame, as_of: datetime) -> DataFrame:
        return freshness_rows(stats, self.sla_hours, layer=self.layer, table=self.table, as_of=as_of)
