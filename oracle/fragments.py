"""SQL building blocks of the oracle statements.

Rounding is written out because DuckDB rounds binary doubles: values are rounded
half up on their shortest decimal text, means on whole numbers.
"""

from __future__ import annotations


def rnd(x: str, k: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,15)), {k}) AS DOUBLE)"


def minus(a: str, b: str, k: int) -> str:
    return f"CAST(round(CAST({a} AS DECIMAL(18,4)) - CAST({b} AS DECIMAL(18,4)), {k}) AS DOUBLE)"


def pct(value: str, base: str, k: int = 2) -> str:
    return rnd(f"(({value} - {base}) / nullif({base}, 0) * 100)", k)


def units(x: str, unit: int = 10_000) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,15)) * {unit}) AS BIGINT)"


def mean(x: str, k: int, over: str = "", unit: int = 10_000) -> str:
    """Exact mean of a column with at most log10(unit) decimals, half up at k."""
    s = f"CAST(sum({units(x, unit)}) {over} AS HUGEINT)"
    n = f"count({x}) {over}"
    step = unit // 10**k
    return (
        f"CAST(sign({s}) * ((2 * abs({s}) + {step} * {n}) // nullif(2 * {step} * {n}, 0)) AS DOUBLE) / 1e{k}"
    )


def plain_mean(x: str, unit: int = 10_000) -> str:
    return f"CAST(sum({units(x, unit)}) AS DOUBLE) / {unit}e0 / nullif(CAST(count({x}) AS DOUBLE), 0)"


def rows(n: int, key: str = "ticker_standard") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RAW_BARS = """
raw_bars AS (
  SELECT 'sup' || l_suppkey || '.ns ' AS ticker,
         l_shipdate AS date,
         CASE WHEN l_orderkey % 127 = 0 THEN 0 WHEN l_orderkey % 101 = 0 THEN NULL ELSE o END / 100e0 AS open,
         (CASE WHEN l_orderkey % 107 = 0 THEN greatest(o, c) - 500 ELSE greatest(o, c) + spread END) / 100e0 AS high,
         (CASE WHEN l_orderkey % 103 = 0 THEN -100 ELSE least(o, c) - spread END) / 100e0 AS low,
         CASE WHEN l_orderkey % 113 = 0 THEN NULL ELSE c END / 100e0 AS close,
         CAST(CASE WHEN l_orderkey % 109 = 0 THEN -5 ELSE l_quantity * 100 END AS BIGINT) AS volume,
         l_shipdate + to_hours(18 + l_linenumber) AS ingestion_timestamp,
         'lineitem' AS source,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS ingestion_date,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS record_id
  FROM (
    SELECT *, floor(o * (1 + l_discount - 0.05) + 0.5) AS c
    FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5)
                 + 100000 * CASE WHEN l_suppkey % 2 = 0 THEN days ELSE 3700 - days END AS o,
                 floor(l_tax * 100 + 0.5) * 10 AS spread
          FROM (SELECT *, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS days
                FROM lineitem))
  )
)"""

# The bars of nations: a line item's supplier and its nation are looked up.
NATION_BARS = (
    RAW_BARS.replace("'sup' || l_suppkey || '.ns '", "lower(n_name) || '.ns '")
    .replace("WHEN l_suppkey % 2", "WHEN n_nationkey % 2")
    .replace("FROM lineitem))", "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey))")
)

TYPED = f""",
typed AS (
  SELECT * REPLACE (CAST(date AS DATE) AS date),
         regexp_replace(upper(trim(ticker)), '\\.NS$', '') AS ticker_standard,
         {pct('close', 'open', 4)} AS daily_return_pct,
         {rnd('(high - low)', 2)} AS price_range,
         dayofweek(date) + 1 NOT IN (1, 7) AS is_trading_day
  FROM raw_bars
)"""

FLAGGED = """,
rules AS (
  SELECT *,
    coalesce(open >= 0 AND high >= 0 AND low >= 0 AND close >= 0, false) AS check_no_negative_prices,
    coalesce(high >= low AND high >= close AND high >= open, false) AS check_high_is_highest,
    coalesce(low <= high AND low <= close AND low <= open, false) AS check_low_is_lowest,
    coalesce(volume >= 0, false) AS check_non_negative_volume,
    ticker IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL AS check_no_null_critical_fields,
    coalesce(greatest(open, high, low, close) <= 1e12, true) AND coalesce(volume <= 1e15, true)
      AND coalesce(abs(close / nullif(open, 0)) <= 1e9, true) AS check_values_in_range
  FROM typed
),
flagged AS (
  SELECT *,
    check_no_negative_prices AND check_high_is_highest AND check_low_is_lowest
      AND check_non_negative_volume AND check_no_null_critical_fields AND check_values_in_range AS is_valid,
    concat_ws(',',
      CASE WHEN NOT check_no_negative_prices THEN 'no_negative_prices' END,
      CASE WHEN NOT check_high_is_highest THEN 'high_is_highest' END,
      CASE WHEN NOT check_low_is_lowest THEN 'low_is_lowest' END,
      CASE WHEN NOT check_non_negative_volume THEN 'non_negative_volume' END,
      CASE WHEN NOT check_no_null_critical_fields THEN 'no_null_critical_fields' END,
      CASE WHEN NOT check_values_in_range THEN 'values_in_range' END) AS failure_reasons
  FROM rules
)"""

_CHECKS = (
    "check_no_negative_prices, check_high_is_highest, check_low_is_lowest, "
    "check_non_negative_volume, check_no_null_critical_fields, check_values_in_range, is_valid, failure_reasons"
)

SILVER = f""",
valid AS (SELECT * EXCLUDE ({_CHECKS}) FROM flagged WHERE is_valid),
silver AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker_standard, date
                                 ORDER BY ingestion_timestamp DESC, record_id DESC) AS rn
    FROM valid)
  WHERE rn = 1
)"""

DIMENSIONS = """
ticker_config AS (
  SELECT CAST(s_suppkey + 1 AS INTEGER) AS ticker_id, 'SUP' || s_suppkey || '.NS' AS ticker_symbol,
         'SUP' || s_suppkey AS ticker_clean, 'Co SUP' || s_suppkey AS company_name, r_name AS sector,
         s_suppkey % 7 <> 6 AS is_active, DATE '2024-01-01' AS added_date, TIMESTAMP '2024-01-01' AS last_updated
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
sector_map AS (
  SELECT 'SUP' || s_suppkey AS ticker_standard, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 9 <> 8
)"""

BRONZE = "WITH" + RAW_BARS
TO_TYPED = BRONZE + TYPED
TO_FLAGGED = TO_TYPED + FLAGGED
TO_SILVER = TO_FLAGGED + SILVER + "," + DIMENSIONS
DIMS = "WITH" + DIMENSIONS

_MA = ", ".join(f"{mean('close', 2, rows(n))} AS ma_{n}" for n in (20, 50, 200))
_VS_MA = ", ".join(f"{pct('close', f'ma_{n}')} AS price_vs_ma{n}_pct" for n in (20, 50, 200))

DAILY = f""",
daily AS (
  SELECT ticker_standard, sector, date, open, high, low, close, volume, daily_return_pct, price_range,
         ma_20, ma_50, ma_200, {_VS_MA},
         CASE WHEN ma_20 > ma_50 AND ma_50 > ma_200 THEN 'Bullish'
              WHEN ma_20 < ma_50 AND ma_50 < ma_200 THEN 'Bearish' ELSE 'Neutral' END AS trend_signal,
         ma_20_volume,
         {pct('volume', 'ma_20_volume')} AS volume_vs_avg_pct
  FROM (SELECT *, {_MA}, CAST({mean('volume', 0, rows(20), 1)} AS BIGINT) AS ma_20_volume FROM silver) AS bars
  LEFT JOIN sector_map USING (ticker_standard)
)"""

SECTOR_DAILY = f""",
sector_daily AS (
  SELECT *, CASE WHEN avg_daily_return_pct > 1 THEN 'Positive' WHEN avg_daily_return_pct < -1 THEN 'Negative'
                 ELSE 'Neutral' END AS sector_sentiment
  FROM (
    SELECT sector, date, count(ticker_standard) AS stock_count,
           {mean('close', 2)} AS avg_close_price,
           {mean('daily_return_pct', 2)} AS avg_daily_return_pct,
           {rnd('stddev_samp(daily_return_pct)', 2)} AS return_volatility,
           {mean('price_vs_ma20_pct', 2)} AS avg_price_vs_ma20_pct,
           {mean('price_vs_ma50_pct', 2)} AS avg_price_vs_ma50_pct,
           CAST(sum(volume) AS BIGINT) AS total_volume,
           CAST({mean('volume', 0, '', 1)} AS BIGINT) AS avg_volume,
           {mean('volume_vs_avg_pct', 2)} AS avg_volume_vs_avg_pct,
           count(*) FILTER (trend_signal = 'Bullish') AS bullish_count,
           count(*) FILTER (trend_signal = 'Bearish') AS bearish_count,
           count(*) FILTER (trend_signal = 'Neutral') AS neutral_count,
           count(*) FILTER (daily_return_pct > 0) AS gainers_count,
           count(*) FILTER (daily_return_pct < 0) AS losers_count,
           max(daily_return_pct) AS best_performer_return,
           min(daily_return_pct) AS worst_performer_return
    FROM daily WHERE sector IS NOT NULL GROUP BY sector, date)
)"""


def _side(name: str, direction: str) -> str:
    return f"""
    SELECT date, ticker_standard, sector, '{name}' AS mover_type,
           CAST(row_number() OVER (PARTITION BY date ORDER BY daily_return_pct {direction}, ticker_standard) AS INTEGER)
             AS rank_position,
           close, daily_return_pct, volume, volume_vs_avg_pct, trend_signal
    FROM daily WHERE daily_return_pct IS NOT NULL"""


MOVERS = f""",
movers AS (
  SELECT * FROM ({_side('Gainer', 'DESC')} UNION ALL {_side('Loser', 'ASC')}) WHERE rank_position <= 10
)"""

OVERVIEW = f""",
overview AS (
  SELECT *, {rnd('advancing_stocks / CAST(nullif(declining_stocks, 0) AS DOUBLE)', 2)} AS advance_decline_ratio,
         CASE WHEN advancing_stocks > declining_stocks * 1.5 THEN 'Bullish'
              WHEN declining_stocks > advancing_stocks * 1.5 THEN 'Bearish' ELSE 'Neutral' END AS market_sentiment
  FROM (
    SELECT date, count(ticker_standard) AS total_stocks, count(DISTINCT sector) AS sectors_tracked,
           {mean('daily_return_pct', 2)} AS market_avg_return_pct,
           {rnd('stddev_samp(daily_return_pct)', 2)} AS market_volatility,
           {rnd('quantile_disc(daily_return_pct, 0.5)', 2)} AS median_return_pct,
           {mean('close', 2)} AS avg_stock_price,
           {mean('price_range', 2)} AS avg_price_range,
           CAST(sum(volume) AS BIGINT) AS total_market_volume,
           CAST({mean('volume', 0, '', 1)} AS BIGINT) AS avg_stock_volume,
           count(*) FILTER (daily_return_pct > 0) AS advancing_stocks,
           count(*) FILTER (daily_return_pct < 0) AS declining_stocks,
           count(*) FILTER (daily_return_pct = 0) AS unchanged_stocks,
           count(*) FILTER (trend_signal = 'Bullish') AS bullish_trends,
           count(*) FILTER (trend_signal = 'Bearish') AS bearish_trends,
           count(*) FILTER (close > ma_20) AS above_ma20_count,
           count(*) FILTER (close > ma_50) AS above_ma50_count,
           count(*) FILTER (close > ma_200) AS above_ma200_count,
           max(daily_return_pct) AS best_stock_return,
           min(daily_return_pct) AS worst_stock_return
    FROM daily GROUP BY date)
)"""

_LAGS = ", ".join(
    f"lag(close, {n}) OVER (PARTITION BY ticker_standard ORDER BY date) AS close_{n}" for n in (7, 30, 90, 180)
)
_RETURNS = ", ".join(f"{pct('close', f'close_{n}')} AS return_{n}d_pct" for n in (7, 30, 90, 180))
_VOLATILITY = ", ".join(f"stddev_samp(daily_return_pct) {rows(n)} AS sd_{n}" for n in (7, 30, 90))
_VOLATILITY_R = ", ".join(f"{rnd(f'sd_{n}', 2)} AS volatility_{n}d" for n in (7, 30, 90))

MULTITIME = f""",
multitime AS (
  SELECT ticker_standard, sector, date, close, {_RETURNS}, {_VOLATILITY_R},
         {rnd('(positive / 30e0 * 100)', 1)} AS consistency_score_30d,
         {pct('close', 'high_30d')} AS max_drawdown_30d_pct
  FROM (
    SELECT *, {_LAGS}, {_VOLATILITY},
           CAST(sum(CASE WHEN daily_return_pct > 0 THEN 1 ELSE 0 END) {rows(30)} AS BIGINT) AS positive,
           max(high) {rows(30)} AS high_30d
    FROM silver) AS bars
  LEFT JOIN sector_map USING (ticker_standard)
)"""

STRENGTH = f""",
mapped AS (SELECT silver.*, sector FROM silver LEFT JOIN sector_map USING (ticker_standard)),
market_return AS (SELECT date, {mean('daily_return_pct', 2)} AS market_return_pct FROM mapped GROUP BY date),
sector_return AS (SELECT sector, date, {mean('daily_return_pct', 2)} AS sector_return_pct FROM mapped GROUP BY sector, date),
versus AS (
  SELECT mapped.*, market_return_pct, sector_return_pct,
         {minus('daily_return_pct', 'sector_return_pct', 2)} AS outperformance_vs_sector_pct,
         {minus('daily_return_pct', 'market_return_pct', 2)} AS outperformance_vs_market_pct,
         {minus('sector_return_pct', 'market_return_pct', 2)} AS sector_vs_market_pct,
         CAST(row_number() OVER (PARTITION BY mapped.sector, mapped.date
              ORDER BY daily_return_pct DESC NULLS LAST, ticker_standard) AS INTEGER) AS rank_in_sector,
         count(ticker_standard) OVER (PARTITION BY mapped.sector, mapped.date) AS total_in_sector
  FROM mapped LEFT JOIN market_return ON mapped.date = market_return.date
  LEFT JOIN sector_return ON mapped.sector = sector_return.sector AND mapped.date = sector_return.date
),
strength AS (
  SELECT ticker_standard, sector, date, close, daily_return_pct, sector_return_pct, market_return_pct,
         outperformance_vs_sector_pct, outperformance_vs_market_pct, sector_vs_market_pct,
         {rnd('((1 - (rank_in_sector - 1) / CAST(total_in_sector AS DOUBLE)) * 100)', 1)} AS percentile_in_sector,
         rank_in_sector,
         CASE WHEN outperformance_vs_sector_pct > 0 AND outperformance_vs_market_pct > 0 THEN 'Sector Leader'
              WHEN outperformance_vs_sector_pct > 0 AND outperformance_vs_market_pct <= 0 THEN 'Sector Outperformer'
              WHEN outperformance_vs_sector_pct <= 0 AND outperformance_vs_market_pct > 0 THEN 'Market Outperformer'
              ELSE 'Underperformer' END AS relative_strength_label
  FROM versus
)"""

TECHNICAL = f""",
technical AS (
  SELECT ticker_standard, sector, date, close, high_52w, low_52w,
         distance_from_52w_high_pct, distance_from_52w_low_pct,
         close >= high_52w * 0.98::DOUBLE AS at_52w_high_flag, close <= low_52w * 1.02::DOUBLE AS at_52w_low_flag,
         high_30d, low_30d, high >= high_30d AS breakout_30d_high_flag, low <= low_30d AS breakdown_30d_low_flag,
         volume, avg_volume_20d, volume_ratio, volume_breakout_flag, bb_upper, bb_lower,
         CASE WHEN close >= bb_upper THEN 'Above Upper Band' WHEN close <= bb_lower THEN 'Below Lower Band'
              ELSE 'Within Bands' END AS bb_position,
         coalesce(daily_return_pct > 2 AND volume_breakout_flag, false) AS strong_bullish_signal,
         coalesce(daily_return_pct < -2 AND volume_breakout_flag, false) AS strong_bearish_signal
  FROM (
    SELECT *, coalesce(volume_ratio >= 1.5, false) AS volume_breakout_flag FROM (
      SELECT *, {pct('close', 'high_52w')} AS distance_from_52w_high_pct,
             {pct('close', 'low_52w')} AS distance_from_52w_low_pct,
             {rnd('(volume / CAST(nullif(avg_volume_20d, 0) AS DOUBLE))', 2)} AS volume_ratio,
             {rnd('(ma_20 + 2 * stddev_20)', 2)} AS bb_upper, {rnd('(ma_20 - 2 * stddev_20)', 2)} AS bb_lower
      FROM (
        SELECT *, {rnd('sd_20', 2)} AS stddev_20 FROM (
          SELECT *, max(high) {rows(252)} AS high_52w, min(low) {rows(252)} AS low_52w,
                 max(high) {rows(30)} AS high_30d, min(low) {rows(30)} AS low_30d,
                 CAST({mean('volume', 0, rows(20), 1)} AS BIGINT) AS avg_volume_20d,
                 {mean('close', 2, rows(20))} AS ma_20, stddev_samp(close) {rows(20)} AS sd_20
          FROM silver)))) AS bars
  LEFT JOIN sector_map USING (ticker_standard)
)"""

# Conversion of the numbered timestamps: audit tables as plain statements.
RUNS = """
runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS run_name,
         CASE o_custkey % 3 WHEN 0 THEN 'FULL_LOAD' WHEN 1 THEN 'INCREMENTAL' ELSE 'BACKFILL' END AS run_type,
         o_orderdate AS start_time, o_totalprice / 1000 AS duration_seconds,
         CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status,
         CASE WHEN o_orderstatus = 'O' THEN rpad('run ' || o_orderkey || ' failed ', 150, '.') END AS error_message,
         'scheduler' AS triggered_by, o_custkey AS bronze_rows_in, o_custkey * 2 AS silver_rows_in,
         o_custkey * 3 AS gold_rows_in, CAST(o_orderdate AS DATE) AS processing_date
  FROM orders
)"""

METRICS = """
metrics AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS metric_id,
         CAST(l_orderkey AS VARCHAR) AS run_id, layer AS layer_name, layer || '.t' || (l_suppkey % 5) AS table_name,
         CAST(l_quantity * 1000 AS BIGINT) AS rows_written, l_shipdate AS start_time,
         l_shipdate + to_seconds(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS end_time,
         l_extendedprice / 100 AS duration_seconds,
         CASE WHEN l_linestatus = 'F' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
         CASE WHEN l_linestatus <> 'F' THEN 'step ' || l_linenumber || ' failed' END AS error_message,
         CAST(l_shipdate AS DATE) AS processing_date, l_shipdate AS created_at
  FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'bronze' WHEN 'A' THEN 'silver' ELSE 'gold' END AS layer
        FROM lineitem)
)"""

CHECKS = """
checks AS (
  SELECT CAST(event_id AS VARCHAR) AS check_id, layer AS layer_name, layer || '.t' || (user_id % 10) AS table_name,
         'Check: ' || event_type AS check_name, upper(event_type) AS check_type,
         CASE WHEN value > 50 THEN 'FAIL' WHEN value > 40 THEN 'WARNING' ELSE 'PASS' END AS check_result,
         CAST(1000 AS BIGINT) AS records_checked, CAST(floor(value * 10) AS BIGINT) AS records_failed,
         value AS failure_rate, CAST(50 AS DOUBLE) AS threshold, ts AS checked_at
  FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS layer FROM events)
)"""

FRESHNESS = """
freshness AS (
  SELECT CAST(event_id AS VARCHAR) AS freshness_id, 'bronze.t' || (user_id % 10) AS table_name,
         'bronze' AS layer_name, CAST(ts AS DATE) AS latest_data_date, value AS data_latency_hours,
         value <= 24 AS is_fresh, CAST(24 AS DOUBLE) AS freshness_sla_hours, event_id AS record_count, ts AS checked_at
  FROM events
)"""
