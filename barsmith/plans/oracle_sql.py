"""DuckDB statements that state each query's expected result independently.

They restate the rules in plain SQL over the same parquet tables (views named
after the tables), so a mismatch points at the Spark plan or at the rule text.
Doubles stay doubles on both sides: every literal that takes part in a double
comparison is cast to DOUBLE, since DuckDB reads ``0.10`` as a DECIMAL.
"""

from __future__ import annotations

from .fixtures import MINUTE_BARS_SQL, RAW_BARS_SQL

MINUTE_BARS_SQL_REF = MINUTE_BARS_SQL

THRESHOLD_SQL = """CASE
  WHEN coalesce(name LIKE '%ST%', false)
       AND NOT (coalesce(code LIKE 'sh68%', false)
                OR (coalesce(code LIKE 'sz30%', false) AND trade_date > DATE '2020-08-23')) THEN 0.05::DOUBLE
  WHEN code LIKE 'sh68%' THEN 0.20::DOUBLE
  WHEN code LIKE 'sz30%' AND trade_date > DATE '2020-08-23' THEN 0.20::DOUBLE
  WHEN code LIKE 'bj%' THEN 0.30::DOUBLE
  ELSE 0.10::DOUBLE END"""

# The whole cleaning chain over raw_bars; each CTE is one stage of the rules.
CLEAN_CTES = f"""
_f1 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY trade_date) AS INTEGER) AS pos
  FROM raw_bars WHERE trade_date IS NOT NULL AND code IS NOT NULL),
_f3 AS (
  SELECT * FROM _f1
  WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL
    AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0),
_a1 AS (
  SELECT *, bool_or(pre_close IS NOT NULL) OVER (PARTITION BY src) AS has_pc,
         min(pos) OVER (PARTITION BY src) AS first_pos,
         lag(close) OVER (PARTITION BY src ORDER BY pos) AS prev_close
  FROM _f3),
_p0 AS (
  SELECT *, CASE WHEN has_pc THEN (CASE WHEN pre_close > 0 THEN close / pre_close - 1.0 ELSE 0.0 END)
                 ELSE coalesce(close / prev_close - 1.0, 0.0) END AS pct0
  FROM _a1),
_d AS (
  SELECT *, CASE WHEN pos = 1 AND pct0 = 0 THEN close / open - 1.0 ELSE pct0 END AS pct_change,
         CASE WHEN circulation_market_value > 0 THEN amount / circulation_market_value ELSE 0.0 END AS turnover_rate,
         CASE WHEN volume > 0 THEN amount / volume ELSE close END AS avg_price,
         pos AS trading_days,
         CASE WHEN first_pos <> 1
               AND max(CASE WHEN pos = first_pos THEN pct0 END) OVER (PARTITION BY src) = 0
              THEN 'first_row_dropped' END AS reason1,
         {THRESHOLD_SQL} AS thr
  FROM _p0),
_k4 AS (SELECT * FROM _d WHERE abs(pct_change) <= thr + 0.02::DOUBLE OR pos = 1),
_f5 AS (
  SELECT *, last_value(name) OVER w AS last_name, last_value(amount) OVER w AS last_amount,
         max(CASE WHEN amount IS DISTINCT FROM 0 THEN trade_date END) OVER (PARTITION BY src) AS end_date
  FROM _k4
  WINDOW w AS (PARTITION BY src ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
_kept AS (
  SELECT *, coalesce(reason1, CASE WHEN last_name IS NULL THEN 'last_name_null' END) AS reason0
  FROM _f5
  WHERE NOT ((coalesce(last_name LIKE '%退%', false) OR coalesce(last_name LIKE '%S%', false))
             AND last_amount IS NOT DISTINCT FROM 0)
     OR trade_date <= end_date),
_checked AS (
  SELECT *, coalesce(reason0,
           CASE WHEN bool_or(dupcnt > 1) OVER (PARTITION BY src) THEN 'duplicate_key' END,
           CASE WHEN bool_or(length(code) > 15 OR coalesce(length(name) > 50, false)) OVER (PARTITION BY src)
                THEN 'too_long' END,
           CASE WHEN bool_or(
                  (open IS NOT NULL AND TRY_CAST(open AS DECIMAL(10,2)) IS NULL)
               OR (high IS NOT NULL AND TRY_CAST(high AS DECIMAL(10,2)) IS NULL)
               OR (low IS NOT NULL AND TRY_CAST(low AS DECIMAL(10,2)) IS NULL)
               OR (close IS NOT NULL AND TRY_CAST(close AS DECIMAL(10,2)) IS NULL)
               OR (pre_close IS NOT NULL AND TRY_CAST(pre_close AS DECIMAL(10,2)) IS NULL)
               OR (volume IS NOT NULL AND TRY_CAST(volume AS DECIMAL(20,2)) IS NULL)
               OR (amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(20,2)) IS NULL)
               OR (circulation_market_value IS NOT NULL AND TRY_CAST(circulation_market_value AS DECIMAL(20,2)) IS NULL)
               OR (total_market_value IS NOT NULL AND TRY_CAST(total_market_value AS DECIMAL(20,2)) IS NULL)
               OR (pct_change IS NOT NULL AND TRY_CAST(pct_change AS DECIMAL(10,6)) IS NULL)
               OR (turnover_rate IS NOT NULL AND TRY_CAST(turnover_rate AS DECIMAL(10,6)) IS NULL)
               OR (avg_price IS NOT NULL AND TRY_CAST(avg_price AS DECIMAL(10,2)) IS NULL))
                  OVER (PARTITION BY src) THEN 'numeric_overflow' END) AS reason
  FROM (SELECT *, count(*) OVER (PARTITION BY src, code, trade_date) AS dupcnt FROM _kept)),
clean_daily AS (
  SELECT src, trade_date, code, name, open, high, low, close, pre_close, volume, amount,
         circulation_market_value, total_market_value, pct_change, turnover_rate, avg_price, trading_days
  FROM _checked WHERE reason IS NULL)"""


def with_clean(select: str) -> str:
    return f"WITH {RAW_BARS_SQL},{CLEAN_CTES}\n{select}"


def with_ctes(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}" if ctes.strip() else select


def with_raw(ctes: str, select: str) -> str:
    sep = "," if ctes.strip() else ""
    return f"WITH {RAW_BARS_SQL}{sep}{ctes}\n{select}"


DAILY_VALUE_COLUMNS = ("open", "high", "low", "close", "pre_close", "volume", "amount", "name",
                       "circulation_market_value", "total_market_value", "pct_change",
                       "turnover_rate", "avg_price", "trading_days")


def merge_sql(target: str, source: str, keys: tuple[str, ...], columns: tuple[str, ...],
              source_columns: tuple[str, ...]) -> str:
    """FULL JOIN statement of the upsert: source values win for the columns it carries."""
    hit = f"s.{keys[0]} IS NOT NULL"
    out = []
    for c in columns:
        if c in keys:
            out.append(f"coalesce(t.{c}, s.{c}) AS {c}")
        elif c in source_columns:
            out.append(f"CASE WHEN {hit} THEN s.{c} ELSE t.{c} END AS {c}")
        else:
            out.append(f"t.{c} AS {c}")
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    return f"SELECT {', '.join(out)} FROM {target} t FULL OUTER JOIN {source} s ON {on}"
