"""Dimension tables derived from stored bars (D8): calendar, missing sessions, name history, stock list.

Input is a frame with one row per ``(code, trade_date)``, the stored table's key. Every
step along a code's bars works on a :class:`Series`, so a code beyond ``max_rows`` rows is
cut into segments and no window spans it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .series import Series, _small, as_series

KEY = "code"
DATE = "trade_date"
#: A calendar of more sessions than this (some four centuries of trading days) is joined by shuffle.
MAX_SESSIONS = 100_000


def trade_calendar(bars: DataFrame) -> DataFrame:
    """Sessions of the market: every distinct trade date, its number, the one before and the codes traded.

    ``(trade_date, session_no, prev_session, gap_days, codes)``, one row per date on which
    any code has a bar. The dates are numbered year by year with a carry between years.
    """
    days = bars.where(F.col(DATE).isNotNull()).groupBy(DATE).agg(F.count(F.lit(1)).alias("codes"))
    days = _small(days.withColumns({"_market": F.lit(0), "_year": F.year(DATE)}))
    s = Series(days, "_market", [DATE], segmented=True, seg="_year").position("session_no").lag(DATE, "prev_session")
    return s.df.select(DATE, "session_no", "prev_session", F.datediff(DATE, "prev_session").alias("gap_days"), "codes")


def _with_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with the number of their session; the calendar is broadcast while it is short."""
    numbers = calendar.select(DATE, "session_no")
    return bars.join(F.broadcast(numbers) if calendar.count() <= MAX_SESSIONS else numbers, DATE)


def missing_sessions(bars: DataFrame, calendar: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Sessions between a code's first and last bar on which it has none: ``(code, session_no, trade_date)``.

    A bar whose predecessor lies more than one session back opens a sequence of missing
    numbers, so only what is missing is generated, never codes x sessions.
    """
    rows = _with_sessions(bars.select(KEY, DATE), calendar).select(KEY, "session_no")
    s = as_series(rows, KEY, ["session_no"], F.col("session_no"), max_rows).lag("session_no", "_prev")
    gaps = s.df.where(F.col("session_no") - F.col("_prev") > 1)
    holes = gaps.select(KEY, F.explode(F.sequence(F.col("_prev") + 1, F.col("session_no") - 1)).alias("session_no"))
    dates = calendar.select("session_no", DATE)
    return holes.join(F.broadcast(dates) if calendar.count() <= MAX_SESSIONS else dates, "session_no").select(KEY, "session_no", DATE)


def is_st(name: Column) -> Column:
    return rules.has(name, "ST")


def is_suspended(volume: Column) -> Column:
    """A day without volume: none stored, or zero."""
    return F.coalesce(volume, F.lit(0.0)) == 0


def name_history(bars: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Validity intervals of each code's name, ST state and suspension: gaps and islands over its bars.

    A new version starts where any of the three differs from the bar before. Per version:
    its number in the code, the state, first and last date, bars, the date the next one
    starts (NULL for the current one) and ``is_current``.
    """
    state = F.struct("name", is_st(F.col("name")).alias("is_st"), is_suspended(F.col("volume")).alias("suspended"))
    rows = bars.select(KEY, DATE, state.alias("state"))
    s = as_series(rows, KEY, [DATE], F.unix_date(DATE), max_rows).lag("state", "_prev")
    changed = ~F.col("state").eqNullSafe(F.col("_prev"))
    s = s.running(version=("sum", changed.cast("int")))
    runs = s.df.groupBy(KEY, "version").agg(F.min("state").alias("state"), F.min(DATE).alias("valid_from"), F.max(DATE).alias("valid_to"),
                                            F.count(F.lit(1)).alias("bars"))
    # A code may change at every bar, so its versions are a series as long as its bars.
    versions = as_series(runs, KEY, ["version"], F.col("version"), max_rows).lead("valid_from", "next_from")
    return versions.df.select(KEY, F.col("version").cast("int").alias("version"), "state.name", "state.is_st", "state.suspended", "valid_from", "valid_to",
                              "bars", "next_from", F.col("next_from").isNull().alias("is_current"))


def stock_info(bars: DataFrame) -> DataFrame:
    """One row per code: latest name, first and last bar, bars, ST and delisting marks of the latest name."""
    out = bars.groupBy(KEY).agg(F.max(F.struct(DATE, "name")).alias("_l"), F.min(DATE).alias("listed_on"), F.max(DATE).alias("last_on"),
                                F.count(F.lit(1)).alias("bars"), F.count_if(is_suspended(F.col("volume"))).alias("suspended_days"))
    name = F.col("_l.name")
    return out.select(KEY, name.alias("name"), "listed_on", "last_on", "bars", "suspended_days", is_st(name).alias("is_st"),
                      rules.has(name, "退").alias("delisting"))
