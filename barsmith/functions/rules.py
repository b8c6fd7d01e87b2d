"""Row-level rule expressions of the cleaner (operators C4-C12, C14).

Each function returns a ``Column``; none of them divides without a guard, so
ANSI mode never raises, and every threshold is a double as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import contracts as K


def starts(c: Column, prefix: str) -> Column:
    """Case-sensitive prefix match, NULL → false."""
    return F.coalesce(c.startswith(prefix), F.lit(False))


def has(c: Column, part: str) -> Column:
    """Case-sensitive substring match, NULL → false."""
    return F.coalesce(c.contains(part), F.lit(False))


def pct_from_pre_close(close: Column, pre_close: Column) -> Column:
    """C4: ``close / pre_close - 1`` when pre_close > 0, else 0 (NULL pre_close → 0)."""
    return F.when(pre_close > 0, close / pre_close - 1.0).otherwise(F.lit(0.0))


def pct_from_lag(close: Column, prev_close: Column) -> Column:
    """Return against the previous surviving close; first row → 0."""
    return F.coalesce(close / prev_close - 1.0, F.lit(0.0))


def turnover_rate(amount: Column, cmv: Column) -> Column:
    """``amount / circulation_market_value`` when cmv > 0, else 0."""
    return F.when(cmv > 0, amount / cmv).otherwise(F.lit(0.0))


def avg_price(amount: Column, volume: Column, close: Column) -> Column:
    """``amount / volume`` when volume > 0, else the close."""
    return F.when(volume > 0, amount / volume).otherwise(close)


def limit_threshold(code: Column, name: Column, trade_date: Column, name_present: Column) -> Column:
    """The board's daily price limit; later rules win in the reference's order.

    bj → 0.30, sh68 → 0.20, sz30 after the switch → 0.20, else 0.10; an ST name
    then lowers the limit to 0.05 unless the code is sh68 or new-rule sz30.
    """
    star = starts(code, K.PREFIX_STAR)
    new_chinext = starts(code, K.PREFIX_CHINEXT) & (trade_date > F.lit(K.CHINEXT_SWITCH_DATE).cast("date"))
    st = name_present & has(name, K.ST_MARK)
    return (
        F.when(st & ~(star | new_chinext), F.lit(K.LIMIT_ST))
        .when(star, F.lit(K.LIMIT_STAR))
        .when(new_chinext, F.lit(K.LIMIT_CHINEXT_NEW))
        .when(starts(code, K.PREFIX_BJ), F.lit(K.LIMIT_BJ))
        .otherwise(F.lit(K.LIMIT_DEFAULT))
    )


def within_limit(pct: Column, threshold: Column, pos: Column) -> Column:
    """F4 + W5 + C12: keep ``|pct| <= threshold + 0.02`` or the first row of the series."""
    return F.coalesce(F.abs(pct) <= threshold + F.lit(K.LIMIT_TOLERANCE), F.lit(False)) | (pos == 1)


def delist_name(name: Column) -> Column:
    """A name that marks delisting (any of the marks, case-sensitive)."""
    out = F.lit(False)
    for mark in K.DELIST_MARKS:
        out = out | has(name, mark)
    return out


def too_long(code: Column, name: Column) -> Column:
    """C14: string longer than the stored column allows."""
    return F.coalesce(F.length(code) > K.CODE_MAX_LEN, F.lit(False)) | F.coalesce(
        F.length(name) > K.NAME_MAX_LEN, F.lit(False))
