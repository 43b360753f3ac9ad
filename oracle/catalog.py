"""One statement per registered query."""

from __future__ import annotations

from oracle.fragments import (
    BRONZE,
    CHECKS,
    DAILY,
    DIMS,
    FRESHNESS,
    METRICS,
    MOVERS,
    MULTITIME,
    NATION_BARS,
    OVERVIEW,
    RUNS,
    SECTOR_DAILY,
    STRENGTH,
    TECHNICAL,
    TO_FLAGGED,
    TO_SILVER,
    TO_TYPED,
    mean,
    plain_mean,
    rnd,
)
from oracle.fragments import DIMENSIONS as _DIMENSIONS

BAR = "ticker, date, open, high, low, close, volume, ingestion_timestamp, source, ingestion_date"
AS_OF = "TIMESTAMP '2001-11-05'"
TO_DAILY = TO_SILVER + DAILY


def _screen(ctes: str, table: str, where: str, order: str, k: int | None, columns: str, day: str | None = None) -> tuple[str, str]:
    """The screen for the newest or the given day, and for every day."""
    cond = f" AND {where}" if where else ""
    limit = f" LIMIT {k}" if k else ""
    when = f"DATE '{day}'" if day else f"(SELECT max(date) FROM {table})"
    latest = (
        f"{ctes} SELECT {columns} FROM {table} WHERE date = {when}{cond} "
        f"ORDER BY {order}{limit}"
    )
    names = ", ".join(c.strip() for c in columns.split(",") if c.strip() != "date")
    each = f"{ctes} SELECT date, {names} FROM {table} WHERE true{cond}"
    if k:
        each += f" QUALIFY row_number() OVER (PARTITION BY date ORDER BY {order}) <= {k}"
    return latest, each


def _best(c: str) -> str:
    return f"{c} DESC NULLS LAST, ticker_standard"


_SCREENS = {
    "momentum": (
        TO_SILVER + MULTITIME, "multitime",
        "return_7d_pct > 0 AND return_30d_pct > 0 AND return_90d_pct > 0 AND consistency_score_30d > 60",
        _best("return_30d_pct"), 10,
        "ticker_standard, sector, close, return_7d_pct, return_30d_pct, return_90d_pct, return_180d_pct, "
        "consistency_score_30d, volatility_30d, max_drawdown_30d_pct",
    ),
    "consistent_uptrend": (
        TO_SILVER + MULTITIME, "multitime",
        "return_7d_pct > 0 AND return_30d_pct > 0 AND return_90d_pct > 0 AND consistency_score_30d > 60",
        _best("return_30d_pct"), None,
        "ticker_standard, return_30d_pct, consistency_score_30d, volatility_30d",
    ),
    "top_performers_30d": (
        TO_SILVER + MULTITIME, "multitime", "", _best("return_30d_pct"), 5,
        "ticker_standard, sector, date, close, return_7d_pct, return_30d_pct, return_90d_pct, return_180d_pct, "
        "volatility_7d, volatility_30d, volatility_90d, consistency_score_30d, max_drawdown_30d_pct",
    ),
    "sector_leaders": (
        TO_SILVER + STRENGTH, "strength",
        "relative_strength_label = 'Sector Leader' AND percentile_in_sector >= 80",
        _best("outperformance_vs_sector_pct"), 10,
        "ticker_standard, sector, close, daily_return_pct, sector_return_pct, market_return_pct, "
        "outperformance_vs_sector_pct, outperformance_vs_market_pct, percentile_in_sector, relative_strength_label",
    ),
    "leaders_by_outperformance": (
        TO_SILVER + STRENGTH, "strength", "relative_strength_label = 'Sector Leader'",
        _best("outperformance_vs_sector_pct"), 5,
        "ticker_standard, sector, date, close, daily_return_pct, sector_return_pct, market_return_pct, "
        "outperformance_vs_sector_pct, outperformance_vs_market_pct, sector_vs_market_pct, percentile_in_sector, "
        "rank_in_sector, relative_strength_label",
    ),
    "breakouts": (
        TO_SILVER + TECHNICAL, "technical",
        "breakout_30d_high_flag AND volume_breakout_flag AND distance_from_52w_high_pct > -10",
        _best("volume_ratio"), 10,
        "ticker_standard, sector, close, distance_from_52w_high_pct, high_30d, volume, avg_volume_20d, volume_ratio, "
        "bb_position, breakout_30d_high_flag, volume_breakout_flag, strong_bullish_signal",
    ),
    "at_year_high": (
        TO_SILVER + TECHNICAL, "technical", "at_52w_high_flag AND volume_breakout_flag", _best("volume_ratio"), 5,
        "ticker_standard, sector, date, close, high_52w, low_52w, distance_from_52w_high_pct, "
        "distance_from_52w_low_pct, at_52w_high_flag, at_52w_low_flag, high_30d, low_30d, breakout_30d_high_flag, "
        "breakdown_30d_low_flag, volume, avg_volume_20d, volume_ratio, volume_breakout_flag, bb_upper, bb_lower, "
        "bb_position, strong_bullish_signal, strong_bearish_signal",
    ),
    "near_year_high": (
        TO_SILVER + TECHNICAL, "technical", "distance_from_52w_high_pct > -5 AND volume_ratio > 1.2",
        _best("distance_from_52w_high_pct"), None,
        "ticker_standard, close, distance_from_52w_high_pct, volume_ratio",
    ),
    "bullish_alignment": (
        TO_DAILY, "daily", "trend_signal = 'Bullish' AND price_vs_ma20_pct > 0", _best("daily_return_pct"), 10,
        "ticker_standard, sector, date, close, ma_20, ma_50, ma_200, daily_return_pct, trend_signal, price_vs_ma20_pct",
    ),
    "portfolio": (
        TO_DAILY, "daily", "", "ticker_standard", None,
        "ticker_standard, close, ma_20, ma_50, ma_200, trend_signal",
    ),
    "sector_performance": (
        TO_DAILY + SECTOR_DAILY, "sector_daily", "", "avg_daily_return_pct DESC NULLS LAST, sector", None,
        "sector, stock_count, avg_daily_return_pct, return_volatility, total_volume, gainers_count, losers_count, "
        "sector_sentiment",
    ),
    "sector_heatmap": (
        TO_DAILY + SECTOR_DAILY, "sector_daily", "", "sector", None, "sector, avg_daily_return_pct, return_volatility",
    ),
    "movers": (
        TO_DAILY + MOVERS, "movers", "rank_position <= 5", "mover_type DESC, rank_position", None,
        "mover_type, rank_position, ticker_standard, sector, close, daily_return_pct, volume, volume_vs_avg_pct",
    ),
    "gainers_alert": (
        TO_DAILY + MOVERS, "movers", "mover_type = 'Gainer'", "rank_position", None,
        "ticker_standard, daily_return_pct",
    ),
}


_DAYS = {"momentum": "1999-12-24", "consistent_uptrend": "1999-12-24", "breakouts": "2001-07-08"}


def _screen_statements() -> dict[str, str]:
    out = {}
    for name, spec in _SCREENS.items():
        out[f"screen_{name}"], out[f"screen_{name}_daily"] = _screen(*spec, day=_DAYS.get(name))
    return out


_PER_SECTOR = (
    "row_number() OVER (PARTITION BY date, sector ORDER BY percentile_in_sector DESC NULLS LAST, ticker_standard) <= 3"
)

_UPSERT = """,
source AS (SELECT * REPLACE (volume + 1 AS volume) FROM silver WHERE date >= DATE '1999-07-01'),
target AS (SELECT * FROM silver WHERE date < DATE '2000-01-01')
SELECT ticker, date, close, volume, record_id FROM source
UNION ALL
SELECT ticker, date, close, volume, record_id FROM target
ANTI JOIN source USING (ticker_standard, date)"""


def _span(label: str, table: str) -> str:
    return (
        f"SELECT '{label}' AS source, count(*) AS total_records, count(DISTINCT ticker) AS unique_tickers, "
        f"min(date) AS earliest_date, max(date) AS latest_date FROM {table}"
    )


def _layer(label: str, table: str, day: str = "date") -> str:
    return (
        f"SELECT '{label}' AS layer, count(*) AS total_records, count(DISTINCT ticker) AS unique_tickers, "
        f"count(DISTINCT {day}) AS unique_dates FROM {table}"
    )


def _graded(rate: str, threshold: float) -> str:
    return (
        f"CASE WHEN {rate} > {threshold!r}::DOUBLE THEN 'FAIL' "
        f"WHEN {rate} > {threshold!r}::DOUBLE * 0.8::DOUBLE THEN 'WARNING' ELSE 'PASS' END"
    )


def _check(check_type: str, name: str, slug: str, details: str, threshold: float, layer: str, table: str, source: str) -> str:
    """Audit row from a source with columns ``checked`` and ``failed``."""
    rate = "coalesce(failed / nullif(CAST(checked AS DOUBLE), 0), 0)"
    return f"""
SELECT 'run-1:{table}:{slug}' AS check_id, 'run-1' AS run_id, '{layer}' AS layer_name, '{table}' AS table_name,
       '{name}' AS check_name, '{check_type}' AS check_type, {_graded(rate, threshold)} AS check_result,
       checked AS records_checked, failed AS records_failed, {rate} * 100 AS failure_rate,
       {threshold!r}::DOUBLE * 100 AS threshold, {details} AS check_details,
       {AS_OF} AS checked_at, CAST({AS_OF} AS DATE) AS processing_date, {AS_OF} AS created_at
FROM ({source})"""


def _nulls(table: str, columns: list[str], threshold: float, layer: str, full: str) -> str:
    parts = []
    for c in columns:
        source = f"SELECT count(*) AS checked, count(*) - count({c}) AS failed FROM {table}"
        details = (
            f"""'{{"column":"{c}","null_count":' || failed || ',"null_rate":' || """
            "CAST(CAST(coalesce(failed / nullif(CAST(checked AS DOUBLE), 0), 0) AS DECIMAL(10,4)) AS VARCHAR) || '}'"
        )
        parts.append(_check("NULL_CHECK", f"Null Check: {c}", f"null:{c}", details, threshold, layer, full, source))
    return " UNION ALL ".join(parts)


def _duplicates(table: str, keys: list[str], threshold: float, layer: str, full: str) -> str:
    source = (
        "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS checked, "
        "CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS failed "
        f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(keys)})"
    )
    listed = ",".join(f'"{k}"' for k in keys)
    details = f"""'{{"key_columns":[{listed}],"duplicate_count":' || failed || '}}'"""
    return _check(
        "DUPLICATE_CHECK", "Duplicate Check: " + ", ".join(keys), "duplicate:" + ",".join(keys), details,
        threshold, layer, full, source,
    )


def _fresh(table: str, sla: int, layer: str, full: str, landed: str) -> str:
    hours = f"(epoch_us({AS_OF}) - epoch_us(CAST(max(date) AS TIMESTAMP))) / 3600e6"
    return f"""
SELECT '{full}:2001-11-05T00:00:00' AS freshness_id, '{full}' AS table_name, '{layer}' AS layer_name,
       CAST(max(date) AS DATE) AS latest_data_date, {landed} AS latest_ingestion_time, {AS_OF} AS current_check_time,
       {hours} AS data_latency_hours, coalesce({hours} <= {sla}, false) AS is_fresh,
       CAST({sla} AS DOUBLE) AS freshness_sla_hours, count(*) AS record_count, CAST(min(date) AS DATE) AS min_date,
       CAST(max(date) AS DATE) AS max_date, {AS_OF} AS checked_at, {AS_OF} AS created_at
FROM {table}"""


def _metric(table: str, read: str | None, operation: str, layer: str, full: str) -> str:
    rows_read = f"(SELECT count(*) FROM {read})" if read else "CAST(0 AS BIGINT)"
    zero = "CAST(0 AS BIGINT)"
    return f"""
SELECT 'run-1:{full}:{operation}' AS metric_id, 'run-1' AS run_id, '{layer}' AS layer_name, '{full}' AS table_name,
       '{operation}' AS operation, {rows_read} AS rows_read, (SELECT count(*) FROM {table}) AS rows_written,
       {zero} AS rows_updated, {zero} AS rows_deleted, {zero} AS bytes_read, {zero} AS bytes_written,
       {AS_OF} AS start_time, {AS_OF} AS end_time, CAST(0 AS DOUBLE) AS duration_seconds, 'SUCCESS' AS status,
       CAST(NULL AS VARCHAR) AS error_message, CAST({AS_OF} AS DATE) AS processing_date, {AS_OF} AS created_at"""


RAW_NAME, SILVER_NAME, GOLD_NAME = "bronze.stock_prices_raw", "silver.stock_prices_clean", "gold.stock_daily_metrics"
_AVG_SECONDS = "CAST(sum(CAST(duration_seconds AS DECIMAL(18,6))) AS DOUBLE) / count(duration_seconds)"

STATEMENTS: dict[str, str] = {
    "bars_raw": f"{BRONZE} SELECT * FROM raw_bars",
    "bars_normalised": f"""WITH{NATION_BARS} SELECT ticker, date, open, high, low, close, volume,
        {AS_OF} AS ingestion_timestamp, 'vendor' AS source, CAST({AS_OF} AS DATE) AS ingestion_date FROM raw_bars""",
    "ingest_date_range": f"""{BRONZE} SELECT * FROM raw_bars
        WHERE date >= DATE '2001-08-01' - 1825 AND date < DATE '2001-08-01'""",
    "universe_active": f"{DIMS} SELECT ticker_symbol FROM ticker_config WHERE is_active ORDER BY ticker_id",
    "bars_of_universe": f"""{BRONZE},{_DIMENSIONS} SELECT * FROM raw_bars WHERE upper(trim(ticker)) IN
        (SELECT upper(trim(ticker_symbol)) FROM ticker_config WHERE is_active)""",
    "daily_json_roundtrip": f"{BRONZE} SELECT {BAR} FROM raw_bars",
    "stream_ingest": f"{BRONZE} SELECT {BAR} FROM raw_bars",
    "stream_vs_batch": f"{BRONZE} {_span('Streaming Table', 'raw_bars')} UNION ALL {_span('Batch Table', 'raw_bars')}",
    "clean_typed": f"{TO_TYPED} SELECT * FROM typed",
    "quality_flags": f"{TO_FLAGGED} SELECT * FROM flagged",
    "quality_valid": f"{TO_SILVER} SELECT * FROM valid",
    "quality_quarantine": f"{TO_FLAGGED} SELECT *, {AS_OF} AS quarantine_timestamp FROM flagged WHERE NOT is_valid",
    "quality_rule_counts": f"""{TO_FLAGGED} SELECT count(*) AS total_records,
        count(*) FILTER (is_valid) AS valid_records, count(*) FILTER (NOT is_valid) AS quarantined_records,
        {rnd('(count(*) FILTER (is_valid) / CAST(count(*) AS DOUBLE) * 100)', 2)} AS valid_pct,
        count(*) FILTER (check_no_negative_prices) AS pass_no_negative_prices,
        count(*) FILTER (check_high_is_highest) AS pass_high_is_highest,
        count(*) FILTER (check_low_is_lowest) AS pass_low_is_lowest,
        count(*) FILTER (check_non_negative_volume) AS pass_non_negative_volume,
        count(*) FILTER (check_no_null_critical_fields) AS pass_no_null_critical_fields,
        count(*) FILTER (check_values_in_range) AS pass_values_in_range FROM flagged""",
    "duplicate_keys": f"""{TO_SILVER} SELECT ticker_standard, date, count(*) AS count FROM valid
        GROUP BY ticker_standard, date HAVING count(*) > 1""",
    "dedup_latest": f"{TO_SILVER} SELECT * FROM silver",
    "gap_report": f"""{TO_SILVER} SELECT ticker, date, prev_date, CAST(date - prev_date AS INTEGER) AS days_gap
        FROM (SELECT *, lag(date) OVER (PARTITION BY ticker_standard ORDER BY date) AS prev_date FROM silver)
        WHERE date - prev_date > 3""",
    "upsert_silver": TO_SILVER + _UPSERT,
    "upsert_silver_table": TO_SILVER + _UPSERT,
    "dimension_maintain": f"""{DIMS} SELECT ticker_id, ticker_symbol, ticker_clean, company_name, sector,
        CASE WHEN ticker_symbol = 'SUP3.NS' THEN false ELSE is_active END AS is_active, added_date,
        CASE WHEN ticker_symbol = 'SUP3.NS' THEN TIMESTAMP '2024-06-01' ELSE last_updated END AS last_updated
        FROM ticker_config
        UNION ALL SELECT 0, 'NEWCO.NS', 'NEWCO', 'Co NEWCO', 'AFRICA', true, DATE '2024-06-01', TIMESTAMP '2024-06-01'""",
    "sector_map_bootstrap": f"""{DIMS} SELECT DISTINCT ticker_clean AS ticker_standard, sector FROM ticker_config
        WHERE is_active""",
    "unmapped_tickers": f"""{TO_SILVER} SELECT DISTINCT ticker_standard FROM silver
        WHERE ticker_standard NOT IN (SELECT ticker_standard FROM sector_map)""",
    "sector_join": f"""{TO_SILVER} SELECT ticker_standard, sector, date, close, volume FROM silver
        LEFT JOIN sector_map USING (ticker_standard)""",
    "sector_join_inner": f"""{TO_SILVER} SELECT date, sector, count(DISTINCT ticker_standard) AS stock_count,
        {plain_mean('daily_return_pct')} AS avg_return FROM silver JOIN sector_map USING (ticker_standard)
        GROUP BY date, sector""",
    "stock_daily_metrics": f"{TO_DAILY} SELECT * FROM daily",
    "sector_daily_metrics": f"{TO_DAILY + SECTOR_DAILY} SELECT * FROM sector_daily",
    "top_movers_daily": f"{TO_DAILY + MOVERS} SELECT * FROM movers",
    "market_overview_daily": f"{TO_DAILY + OVERVIEW} SELECT * FROM overview",
    "stock_multitime_performance": f"{TO_SILVER + MULTITIME} SELECT * FROM multitime",
    "stock_relative_strength": f"{TO_SILVER + STRENGTH} SELECT * FROM strength",
    "stock_technical_levels": f"{TO_SILVER + TECHNICAL} SELECT * FROM technical",
    "sector_daily_reduced": f"""{TO_DAILY + SECTOR_DAILY}
        SELECT sector, date, stock_count, avg_daily_return_pct, total_volume FROM sector_daily""",
    "gainers_reduced": f"""{TO_DAILY + MOVERS} SELECT date, ticker_standard, sector, daily_return_pct, close
        FROM movers WHERE mover_type = 'Gainer'""",
    **_screen_statements(),
    "screen_top_per_sector": f"""{TO_SILVER + STRENGTH}
        SELECT sector, ticker_standard, percentile_in_sector, relative_strength_label FROM strength
        WHERE date = (SELECT max(date) FROM strength) QUALIFY {_PER_SECTOR}""",
    "screen_top_per_sector_daily": f"""{TO_SILVER + STRENGTH}
        SELECT date, sector, ticker_standard, percentile_in_sector, relative_strength_label FROM strength
        QUALIFY {_PER_SECTOR}""",
    "screen_recent_for_ticker": f"""{TO_DAILY} SELECT * FROM daily WHERE ticker_standard = 'SUP3'
        ORDER BY date DESC LIMIT 5""",
    "screen_market_recent": f"""{TO_DAILY + OVERVIEW} SELECT date, total_stocks, market_avg_return_pct,
        market_volatility, advancing_stocks, declining_stocks, advance_decline_ratio, market_sentiment,
        total_market_volume, above_ma200_count FROM overview ORDER BY date DESC LIMIT 7""",
    "screen_market_scorecard": f"""{TO_DAILY + OVERVIEW} SELECT market_avg_return_pct, advance_decline_ratio,
        market_sentiment FROM overview ORDER BY date DESC LIMIT 1""",
    "screen_recent_bars": f"""{TO_SILVER} SELECT ticker_standard, date, open, high, low, close, volume,
        daily_return_pct, price_range, is_trading_day FROM silver
        WHERE ticker_standard = 'SUP3' AND date >= DATE '2001-08-01' - 30 ORDER BY date DESC LIMIT 20""",
    "profile_bronze_per_ticker": f"""{BRONZE} SELECT ticker, count(*) AS record_count, min(date) AS earliest_date,
        max(date) AS latest_date FROM raw_bars GROUP BY ticker""",
    "profile_silver_per_ticker": f"""{TO_SILVER} SELECT ticker, count(*) AS record_count, min(date) AS earliest_date,
        max(date) AS latest_date, {plain_mean('close')} AS avg_close_price, {plain_mean('volume')} AS avg_volume
        FROM silver GROUP BY ticker ORDER BY ticker LIMIT 20""",
    "profile_bronze_vs_silver": f"{TO_SILVER} {_layer('Bronze', 'raw_bars')} UNION ALL {_layer('Silver', 'silver')}",
    "config_active_by_sector": f"{DIMS} SELECT sector, count(*) AS ticker_count FROM ticker_config WHERE is_active GROUP BY sector",
    "config_tickers_of_sector": f"""{DIMS} SELECT ticker_symbol, company_name FROM ticker_config
        WHERE sector = 'ASIA' AND is_active""",
    "config_count_and_active": f"""{DIMS} SELECT sector, count(*) AS count,
        count(CASE WHEN is_active THEN 1 END) AS active_count FROM ticker_config GROUP BY sector""",
    "mapping_by_sector": f"{DIMS} SELECT sector, count(*) AS ticker_count FROM sector_map GROUP BY sector",
    "mapping_total": f"{DIMS} SELECT count(*) AS total_tickers_mapped FROM sector_map",
    "null_check": f"{BRONZE} {_nulls('raw_bars', ['ticker', 'date', 'open', 'close'], 0.05, 'bronze', RAW_NAME)}",
    "duplicate_check": f"{BRONZE} {_duplicates('raw_bars', ['ticker', 'date'], 0.01, 'bronze', RAW_NAME)}",
    "freshness_check": f"{BRONZE} {_fresh('raw_bars', 24, 'bronze', RAW_NAME, 'max(ingestion_timestamp)')}",
    "layer_profile": f"{TO_SILVER} {_metric('silver', 'raw_bars', 'MERGE', 'silver', SILVER_NAME)}",
    "run_summary": f"""WITH {METRICS} SELECT run_id, 'daily' AS run_name, 'INCREMENTAL' AS run_type,
        min(start_time) AS start_time, max(end_time) AS end_time,
        (epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1e6 AS duration_seconds,
        CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' ELSE 'SUCCESS' END AS status,
        min(error_message) FILTER (status = 'FAILED') AS error_message, 'scheduler' AS triggered_by,
        CAST(coalesce(sum(rows_written) FILTER (layer_name = 'bronze'), 0) AS BIGINT) AS bronze_rows_in,
        CAST(coalesce(sum(rows_written) FILTER (layer_name = 'silver'), 0) AS BIGINT) AS silver_rows_in,
        CAST(coalesce(sum(rows_written) FILTER (layer_name = 'gold'), 0) AS BIGINT) AS gold_rows_in,
        max(processing_date) AS processing_date, max(created_at) AS created_at FROM metrics GROUP BY run_id""",
    "monitored_walk_metrics": f"""{TO_DAILY} {_metric('raw_bars', None, 'INSERT', 'bronze', RAW_NAME)}
        UNION ALL {_metric('silver', 'raw_bars', 'INSERT', 'silver', SILVER_NAME)}
        UNION ALL {_metric('daily', 'silver', 'INSERT', 'gold', GOLD_NAME)}""",
    "monitored_walk_checks": f"""{TO_SILVER} {_nulls('raw_bars', ['ticker', 'date', 'close'], 0.01, 'bronze', RAW_NAME)}
        UNION ALL {_duplicates('raw_bars', ['ticker', 'date'], 0.01, 'bronze', RAW_NAME)}
        UNION ALL {_nulls('silver', ['ticker_standard', 'date'], 0.001, 'silver', SILVER_NAME)}""",
    "monitored_walk_freshness": f"""{TO_DAILY} {_fresh('raw_bars', 24, 'bronze', RAW_NAME, 'max(ingestion_timestamp)')}
        UNION ALL {_fresh('silver', 24, 'silver', SILVER_NAME, 'max(ingestion_timestamp)')}
        UNION ALL {_fresh('daily', 48, 'gold', GOLD_NAME, AS_OF)}""",
    "monitor_recent_runs": f"""WITH {RUNS} SELECT run_name, run_type, status, processing_date, start_time,
        duration_seconds, bronze_rows_in, silver_rows_in, gold_rows_in, triggered_by,
        substring(error_message, 1, 100) AS error_summary FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 10""",
    "monitor_success_rate": f"""WITH {RUNS} SELECT run_name, count(*) AS total_runs,
        count(*) FILTER (status = 'SUCCESS') AS successful_runs, count(*) FILTER (status = 'FAILED') AS failed_runs,
        {rnd("(count(*) FILTER (status = 'SUCCESS') * 1e2 / count(*))", 2)} AS success_rate_pct,
        {mean('duration_seconds', 2, '', 1_000_000)} AS avg_duration_seconds,
        {rnd('min(duration_seconds)', 2)} AS min_duration_seconds,
        {rnd('max(duration_seconds)', 2)} AS max_duration_seconds
        FROM runs WHERE start_time >= DATE '2001-08-01' - 30 GROUP BY run_name""",
    "monitor_layer_performance": f"""WITH {METRICS} SELECT layer_name, table_name, count(*) AS execution_count,
        CAST(sum(rows_written) AS BIGINT) AS total_rows_written, {mean('rows_written', 0, '', 1)} AS avg_rows_written,
        {mean('duration_seconds', 2, '', 1_000_000)} AS avg_duration_seconds,
        {rnd("(CAST(sum(rows_written) AS DOUBLE) / nullif(CAST(sum(CAST(duration_seconds AS DECIMAL(18,6))) AS DOUBLE), 0))", 0)}
          AS avg_throughput_rows_per_sec,
        count(*) FILTER (status = 'SUCCESS') AS successful_runs, count(*) FILTER (status = 'FAILED') AS failed_runs
        FROM metrics WHERE start_time >= DATE '2001-08-01' - 30 GROUP BY layer_name, table_name""",
    "monitor_quality_issues": f"""WITH {CHECKS} SELECT checked_at, layer_name, table_name, check_name, check_type,
        check_result, failure_rate, threshold, records_checked, records_failed FROM checks
        WHERE check_result IN ('FAIL', 'WARNING') AND checked_at >= DATE '2024-01-31' - 7
        ORDER BY checked_at DESC, failure_rate DESC, check_id DESC LIMIT 20""",
    "monitor_freshness": f"""WITH {FRESHNESS} SELECT layer_name, table_name, latest_data_date,
        {rnd('data_latency_hours', 1)} AS latency_hours, freshness_sla_hours AS sla_hours,
        CASE WHEN is_fresh THEN 'FRESH' ELSE 'STALE' END AS freshness_status, record_count,
        checked_at AS last_checked FROM freshness
        QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY checked_at DESC, freshness_id DESC) = 1""",
    "monitor_bottlenecks": f"""WITH {METRICS} SELECT layer_name, table_name, count(*) AS run_count,
        {mean('duration_seconds', 2, '', 1_000_000)} AS avg_duration_sec,
        {rnd('max(duration_seconds)', 2)} AS max_duration_sec, {mean('rows_written', 0, '', 1)} AS avg_rows_written,
        {rnd(f"({plain_mean('rows_written')} / nullif({_AVG_SECONDS}, 0))", 0)} AS avg_throughput,
        CASE WHEN max(duration_seconds) > 2 * ({_AVG_SECONDS}) THEN 'HIGH VARIANCE'
             WHEN {_AVG_SECONDS} > 300 THEN 'SLOW' ELSE 'OK' END AS performance_flag
        FROM metrics WHERE start_time >= DATE '2001-08-01' - 30 AND status = 'SUCCESS'
        GROUP BY layer_name, table_name ORDER BY avg_duration_sec DESC, layer_name, table_name LIMIT 10""",
}

# Written and read back, the rows are the same.
def _ingested(run_id: str, when: str) -> str:
    name = "bronze.stock_prices_stream"
    return f"""SELECT '{run_id}:{name}:APPEND' AS metric_id, '{run_id}' AS run_id, 'bronze' AS layer_name, '{name}' AS table_name, 'APPEND' AS operation,
        count(*) AS rows_read, count(*) AS rows_written, true AS has_bytes, 'SUCCESS' AS status FROM raw_bars WHERE {when}"""


_CUT_OFF = "'{\"ticker\": \"' || ticker || '\", \"volume\": ' || volume AS line FROM raw_bars WHERE volume % 700 = 0"

STATEMENTS |= {
    "stream_audit": f"{BRONZE} {_ingested('run-1', early := 'date < DATE ' + repr('2000-01-01'))} UNION ALL {_ingested('run-2', f'NOT {early}')}",
    "stream_unexpected": f"""{BRONZE} SELECT ticker, date, close,
        CASE WHEN date >= DATE '2000-01-01' THEN {rnd('(close * volume)', 2)} END AS turnover, NULL AS line FROM raw_bars
        UNION ALL SELECT NULL, NULL, NULL, NULL, {_CUT_OFF} UNION ALL SELECT NULL, NULL, NULL, NULL, {_CUT_OFF}""",
    "tables_created": f"""WITH {RUNS}, {METRICS} SELECT processing_date, runs, metrics, rows_written FROM
        (SELECT CAST(date_trunc('year', processing_date) AS DATE) AS processing_date, count(*) AS runs FROM runs GROUP BY 1)
        FULL JOIN (SELECT CAST(date_trunc('year', processing_date) AS DATE) AS processing_date, count(*) AS metrics,
            CAST(sum(rows_written) AS BIGINT) AS rows_written FROM metrics GROUP BY 1) USING (processing_date)""",
    # Tables that were refreshed with one month's bars equal those of all bars.
    **{
        f"{name}_refreshed": STATEMENTS[name]
        for name in (
            "stock_daily_metrics", "sector_daily_metrics", "top_movers_daily", "market_overview_daily",
            "stock_multitime_performance", "stock_relative_strength", "stock_technical_levels",
        )
    },
    "profile_merged": f"{BRONZE} {_span('Bronze', 'raw_bars')}",
    "stock_daily_metrics_bucketed": STATEMENTS["stock_daily_metrics"],
    "bars_appended": STATEMENTS["bars_raw"],
    "quarantine_repeated": STATEMENTS["quality_quarantine"],
    "audit_appended": STATEMENTS["run_summary"],
    "upsert_growing_schema": f"""{TO_SILVER} SELECT ticker_standard, date, close,
        CASE WHEN date >= DATE '1998-06-01' AND date < DATE '2001-01-01' THEN 'late' END AS note FROM silver""",
}
