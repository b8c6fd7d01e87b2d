"""Technical factors on stored bars (operators D1-D5, D7, D9).

The reference names these in its design documents (moving averages with a
formula; ATR, RSI, MACD, adjusted prices and performance metrics by name only),
so the textbook definitions are used and stated per function.

Input is a frame with one row per ``(code, trade_date)`` — the stored table's
key — so a series holds at most one row per trading day and every window over
``partitionBy(code)`` is bounded by the calendar, whatever the data volume.

Minute bars have no such bound. The functions that take a :class:`Series` work on
series cut into segments as well (``minute_series``): windows of the last rows read a
halo of the rows before their segment, running values a carry, and the exponential
means of MACD are a scan of affine maps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Series, as_series

KEY = "code"
DATE = "trade_date"
LOG_SCALE = 1e12


def _w() -> Window:
    return Window.partitionBy(KEY).orderBy(DATE)


def _rows(n: int) -> Window:
    return _w().rowsBetween(-(n - 1), 0)


def rolling_mean(c: Column, n: int) -> Column:
    """Mean of the last ``n`` rows, NULL until ``n`` values exist (pandas ``rolling(n).mean()``)."""
    return F.when(F.count(c).over(_rows(n)) == n, F.avg(c).over(_rows(n)))


def moving_averages(df: DataFrame, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """``ma5``, ``ma20`` of the close."""
    return df.withColumns({f"ma{n}": rolling_mean(F.col("close"), n) for n in windows})


def anomaly_filter(df: DataFrame, limit: float = 0.20) -> DataFrame:
    """Keep close > 0 and volume > 0; change against the previous kept close within ±limit.

    The first row has no change and is dropped, as in the documented handler.
    """
    kept = df.filter((F.col("close") > 0) & (F.col("volume") > 0))
    pct = F.col("close") / F.lag("close").over(_w()) - 1.0
    return kept.withColumn("_pct", pct).filter(F.abs(F.col("_pct")) <= F.lit(limit)).drop("_pct")


def drop_any_null(df: DataFrame) -> DataFrame:
    """D3: rows without any NULL and with a positive close."""
    return df.dropna().filter(F.col("close") > 0)


def true_range(df: DataFrame) -> Column:
    prev = F.lag("close").over(_w())
    hl = F.col("high") - F.col("low")
    return F.greatest(hl, F.coalesce(F.abs(F.col("high") - prev), hl), F.coalesce(F.abs(F.col("low") - prev), hl))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Average true range, simple mean of the last ``n`` true ranges (first TR = high - low)."""
    return df.withColumn("_tr", true_range(df)).withColumn(f"atr_{n}", rolling_mean(F.col("_tr"), n)).drop("_tr")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """RSI with simple means of gains and losses over the last ``n`` changes; 100 without losses."""
    diff = F.col("close") - F.lag("close").over(_w())
    out = df.withColumn("_d", diff).withColumns({
        "_g": F.when(F.col("_d") > 0, F.col("_d")).when(F.col("_d").isNotNull(), F.lit(0.0)),
        "_l": F.when(F.col("_d") < 0, -F.col("_d")).when(F.col("_d").isNotNull(), F.lit(0.0)),
    })
    ag, al = rolling_mean(F.col("_g"), n), rolling_mean(F.col("_l"), n)
    value = F.when(al == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ag / al))
    return out.withColumn(f"rsi_{n}", F.when(ag.isNotNull(), value)).drop("_d", "_g", "_l")


def adjusted_close(df: DataFrame) -> DataFrame:
    """Forward-adjusted close (前复权): past closes scaled by later ``pre_close / previous close`` jumps.

    ``factor_t = exp(sum(log(ratio)))`` up to t; ``adj_close = close * factor_last / factor_t``,
    so the latest price is unchanged. A missing or non-positive ratio counts as 1.
    The logs are summed as whole multiples of 1e-12 (exact integer sums), so the
    result does not depend on the order in which an engine adds them.
    """
    prev = F.lag("close").over(_w())
    ratio = F.when((F.col("pre_close") > 0) & (prev > 0), F.col("pre_close") / prev).otherwise(F.lit(1.0))
    upto = _w().rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(KEY)
    quantum = F.floor(F.log(ratio) * F.lit(LOG_SCALE) + 0.5)
    out = df.withColumn("_lr", quantum).withColumn("_cum", F.sum("_lr").over(upto) / F.lit(LOG_SCALE))
    out = out.withColumn("_last", F.max(F.struct(F.col(DATE), F.col("_cum"))).over(whole)["_cum"])
    return out.withColumn("adj_factor", F.exp(F.col("_cum"))).withColumn(
        "adj_close", F.col("close") * F.exp(F.col("_last") - F.col("_cum"))).drop("_lr", "_cum", "_last")


def drawdown(df: DataFrame) -> DataFrame:
    """Equity curve (close over the first close) and drawdown from the running peak."""
    upto = _w().rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.struct(F.col(DATE), F.col("close"))).over(Window.partitionBy(KEY))["close"]
    return df.withColumns({
        "equity": F.col("close") / first,
        "drawdown": F.lit(1.0) - F.col("close") / F.max("close").over(upto),
    })


def performance(df: DataFrame, periods_per_year: int = 252) -> DataFrame:
    """Per code — mean and volatility of ``pct_change``, Sharpe ratio (no risk-free rate), max drawdown."""
    dd = drawdown(df)
    agg = dd.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("days"), F.avg("pct_change").alias("mean_return"),
        F.stddev_samp("pct_change").alias("volatility"), F.max("drawdown").alias("max_drawdown"))
    sharpe = F.when(F.col("volatility") > 0,
                    F.col("mean_return") / F.col("volatility") * F.lit(math.sqrt(periods_per_year)))
    return agg.withColumn("sharpe", sharpe)


#: Spans of the fast, the slow and the signal line.
MACD_SPANS = (12, 26, 9)


def macd_of(s: Series, close: str = "close") -> Series:
    """``macd``, ``macd_signal`` and ``macd_hist`` of series, however long, by :meth:`Series.ewm`."""
    fast, slow, signal = MACD_SPANS
    out = s.ewm(_fast=(F.col(close), fast), _slow=(F.col(close), slow))
    out = out.with_df(out.df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"))
    out = out.ewm(macd_signal=(F.col("macd"), signal))
    return out.with_df(out.df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")))


def macd(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """MACD(12, 26, 9) per code; series beyond ``max_rows`` rows are cut into segments."""
    # Each exponential mean reads its input twice, so what gave the closes is run once and stored.
    closes = df.select(KEY, DATE, F.col("close").cast("double").alias("close")).checkpoint()
    s = as_series(closes, KEY, [DATE], F.unix_date(DATE), max_rows)
    return macd_of(s).df.drop(s.seg)


# -- series of any length -------------------------------------------------------------

MINUTE_ORDER = [DATE, "time"]


def minute_series(df: DataFrame, max_rows: int | None = None) -> Series:
    """Minute bars (one row per code, date and second of the day) as series, split beyond ``max_rows`` rows."""
    return as_series(df, KEY, MINUTE_ORDER, F.unix_date(DATE).cast("long") * 86400 + F.col("time"), max_rows)


def _mean_of(c: Column, n: int, w: Window) -> Column:
    last = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(last) == n, F.avg(c).over(last))


def moving_averages_of(s: Series, windows: tuple[int, ...] = (5, 20), close: str = "close") -> Series:
    """D1 on series of any length."""
    h = s.halo(max(windows) - 1)
    return h.with_df(h.df.withColumns({f"ma{n}": _mean_of(F.col(close), n, h.local_window()) for n in windows})).without_halo()


def atr_of(s: Series, n: int = 14) -> Series:
    """D4 on series of any length; the halo has one row more, for the close before the oldest range."""
    h = s.halo(n)
    prev = F.lag("close").over(h.local_window())
    hl = F.col("high") - F.col("low")
    tr = F.greatest(hl, F.coalesce(F.abs(F.col("high") - prev), hl), F.coalesce(F.abs(F.col("low") - prev), hl))
    df = h.df.withColumn("_tr", tr)
    return h.with_df(df.withColumn(f"atr_{n}", _mean_of(F.col("_tr"), n, h.local_window())).drop("_tr")).without_halo()


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as IEEE 754 has it: infinite or NaN over zero, where Spark's ANSI division fails."""
    over_zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, over_zero).otherwise(a / b)


def drawdown_of(s: Series) -> Series:
    """D9 on series of any length: equity over the first close, drawdown from the running peak.

    Minute closes are not cleaned: a first close or peak of zero gives infinite or NaN values, as in pandas.
    """
    order = F.struct(*[F.col(c) for c in s.order], F.col("close").alias("_close"))
    out = s.running(_peak=("max", F.col("close"))).aggregate(_start=("min", order))
    close = F.col("close")
    df = out.df.withColumns({"equity": quotient(close, F.col("_start._close")), "drawdown": F.lit(1.0) - quotient(close, F.col("_peak"))})
    return out.with_df(df.drop("_start", "_peak"))
