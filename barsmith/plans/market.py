"""Queries over the market as a whole: dimension tables, point-in-time factors, minute-bar factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as K
from ..operators import asof, dimensions
from ..operators import factors as FX
from . import oracle_sql as O
from .catalog import _r6, _r6_sql, register
from .fixtures import HISTORY_BARS_SQL, REPORTS_SQL, company_reports, history_bars, minute_bars, raw_bars

#: Rows beyond which the queries below split a series. The daily series here stay whole;
#: the minute queries take a bound that most of their series exceed.
MINUTE_ROWS = 40


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_bars(spark, sf_dir).select("code", "trade_date", "name", "volume")


# -- dimension tables (D8) ------------------------------------------------------------

CALENDAR_CTES = HISTORY_BARS_SQL + """,
_days AS (SELECT trade_date, count(*) AS codes FROM raw_bars GROUP BY trade_date),
_cal AS (SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS INTEGER) AS session_no,
                lag(trade_date) OVER (ORDER BY trade_date) AS prev_session, codes FROM _days)"""


@register("trade_calendar", O.with_raw(CALENDAR_CTES, """
SELECT trade_date, session_no, prev_session, CAST(trade_date - prev_session AS INTEGER) AS gap_days, codes FROM _cal"""))
def trade_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sessions from the distinct trade dates."""
    return dimensions.trade_calendar(raw_bars(spark, sf_dir))


@register("missing_sessions", O.with_raw(CALENDAR_CTES, """
SELECT c.code, d.session_no, d.trade_date
FROM (SELECT code, min(trade_date) AS lo, max(trade_date) AS hi FROM raw_bars GROUP BY code) c
JOIN _cal d ON d.trade_date BETWEEN c.lo AND c.hi
WHERE NOT EXISTS (SELECT 1 FROM raw_bars b WHERE b.code = c.code AND b.trade_date = d.trade_date)"""))
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the calendar on which a listed code has no bar; SQL states it as an anti-join of code x session."""
    bars = raw_bars(spark, sf_dir).select("code", "trade_date")
    return dimensions.missing_sessions(bars, dimensions.trade_calendar(bars).checkpoint())


@register("name_history", O.with_raw(HISTORY_BARS_SQL + """,
_st AS (SELECT code, trade_date, name, coalesce(name LIKE '%ST%', false) AS is_st, coalesce(volume, 0) = 0 AS suspended FROM history_bars),
_isl AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date)
                   - row_number() OVER (PARTITION BY code, name, is_st, suspended ORDER BY trade_date) AS g FROM _st),
_ver AS (SELECT code, name, is_st, suspended, min(trade_date) AS valid_from, max(trade_date) AS valid_to, count(*) AS bars
         FROM _isl GROUP BY code, name, is_st, suspended, g)""", """
SELECT code, CAST(row_number() OVER w AS INTEGER) AS version, name, is_st, suspended, valid_from, valid_to, bars,
       lead(valid_from) OVER w AS next_from, lead(valid_from) OVER w IS NULL AS is_current
FROM _ver WINDOW w AS (PARTITION BY code ORDER BY valid_from)"""))
def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of equal name, ST state and suspension; SQL finds them by the difference of two row numbers."""
    return dimensions.name_history(_history(spark, sf_dir))


@register("stock_info", O.with_raw(HISTORY_BARS_SQL, """
SELECT code, max_by(name, trade_date) AS name, min(trade_date) AS listed_on, max(trade_date) AS last_on, count(*) AS bars,
       count(*) FILTER (coalesce(volume, 0) = 0) AS suspended_days, max_by(name, trade_date) LIKE '%ST%' AS is_st,
       max_by(name, trade_date) LIKE '%退%' AS delisting
FROM history_bars GROUP BY code"""))
def stock_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per code with its latest name and listing span."""
    return dimensions.stock_info(_history(spark, sf_dir))


# -- point-in-time factors (D6) ----------------------------------------------------------

@register("pit_valuation", O.with_raw(REPORTS_SQL + """,
_ttm AS (SELECT *, CASE WHEN count(eps) OVER w = 4 THEN sum(eps) OVER w END AS eps_ttm FROM company_reports
         WINDOW w AS (PARTITION BY code ORDER BY announced_on ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""", f"""
SELECT b.code, b.trade_date, r.announced_on, {_r6_sql('r.eps_ttm')} AS eps_ttm, r.bps,
       {_r6_sql('CASE WHEN r.eps_ttm > 0 THEN b.close / r.eps_ttm END')} AS pe, {_r6_sql('CASE WHEN r.bps > 0 THEN b.close / r.bps END')} AS pb
FROM raw_bars b ASOF LEFT JOIN _ttm r ON b.code = r.code AND b.trade_date >= r.announced_on"""))
def pit_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PE and PB of every bar from the reports announced by that day."""
    bars = raw_bars(spark, sf_dir).select("code", "trade_date", "close")
    out = asof.valuation(bars, company_reports(spark, sf_dir).drop("period"))
    return out.select("code", "trade_date", "announced_on", _r6(F.col("eps_ttm")).alias("eps_ttm"), "bps",
                      _r6(F.col("pe")).alias("pe"), _r6(F.col("pb")).alias("pb"))


# -- factors on minute bars (D1, D4, D5, D9 on S14) ----------------------------------------

_MW = "PARTITION BY code ORDER BY trade_date, time"


def _minute_series(spark: SparkSession, sf_dir: str):
    return FX.minute_series(minute_bars(spark, sf_dir).select(*K.MINUTE_KEYS, "high", "low", "close"), MINUTE_ROWS)


def _mroll(x: str, n: int) -> str:
    w = f"({_MW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN avg({x}) OVER {w} END"


@register("minute_ma", O.with_ctes(O.MINUTE_BARS_SQL_REF, f"""
SELECT code, trade_date, time, {_r6_sql(_mroll('close', 5))} AS ma5, {_r6_sql(_mroll('close', 20))} AS ma20 FROM minute_bars"""))
def minute_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 on minute bars: moving averages over split series with halos."""
    out = FX.moving_averages_of(_minute_series(spark, sf_dir)).df
    return out.select(*K.MINUTE_KEYS, _r6(F.col("ma5")).alias("ma5"), _r6(F.col("ma20")).alias("ma20"))


@register("minute_atr", O.with_ctes(O.MINUTE_BARS_SQL_REF, f"""
SELECT code, trade_date, time, {_r6_sql(_mroll('tr', 14))} AS atr_14
FROM (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({_MW})), high - low),
                         coalesce(abs(low - lag(close) OVER ({_MW})), high - low)) AS tr FROM minute_bars)"""))
def minute_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 on minute bars: average true range over split series with halos."""
    return FX.atr_of(_minute_series(spark, sf_dir)).df.select(*K.MINUTE_KEYS, _r6(F.col("atr_14")).alias("atr_14"))


@register("minute_drawdown", O.with_ctes(O.MINUTE_BARS_SQL_REF, f"""
SELECT code, trade_date, time, {_r6_sql(f'close / first_value(close) OVER ({_MW})')} AS equity,
       {_r6_sql(f'1.0 - close / max(close) OVER ({_MW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS drawdown
FROM minute_bars"""))
def minute_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 on minute bars: the running peak is a scan over the segments."""
    out = FX.drawdown_of(_minute_series(spark, sf_dir)).df
    return out.select(*K.MINUTE_KEYS, _r6(F.col("equity")).alias("equity"), _r6(F.col("drawdown")).alias("drawdown"))


def _minute_macd_sql() -> str:
    def step(prev: str, x: str, span: int) -> str:
        return f"{prev} + (2.0::DOUBLE / {span + 1}) * ({x} - {prev})"
    return "WITH RECURSIVE " + O.MINUTE_BARS_SQL_REF + f""",
_s AS (SELECT code, trade_date, time, close, row_number() OVER ({_MW}) AS rn FROM minute_bars),
_e AS (
  SELECT code, rn, trade_date, time, close AS e12, close AS e26 FROM _s WHERE rn = 1
  UNION ALL
  SELECT s.code, s.rn, s.trade_date, s.time, {step('e.e12', 's.close', 12)}, {step('e.e26', 's.close', 26)}
  FROM _e e JOIN _s s ON s.code = e.code AND s.rn = e.rn + 1),
_g AS (
  SELECT code, rn, trade_date, time, e12 - e26 AS macd, e12 - e26 AS sig FROM _e WHERE rn = 1
  UNION ALL
  SELECT m.code, m.rn, m.trade_date, m.time, m.e12 - m.e26, {step('g.sig', '(m.e12 - m.e26)', 9)}
  FROM _g g JOIN _e m ON m.code = g.code AND m.rn = g.rn + 1)
SELECT code, trade_date, time, {_r6_sql('macd')} AS macd, {_r6_sql('sig')} AS macd_signal, {_r6_sql('macd - sig')} AS macd_hist FROM _g"""


@register("minute_macd", _minute_macd_sql())
def minute_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 on minute bars: MACD as a scan of affine maps over split series; SQL restates the recursion."""
    out = FX.macd_of(_minute_series(spark, sf_dir)).df
    return out.select(*K.MINUTE_KEYS, *[_r6(F.col(c)).alias(c) for c in ("macd", "macd_signal", "macd_hist")])
