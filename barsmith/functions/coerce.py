"""Type coercion of raw cells (operators C1, C2, C3).

Cells arrive as strings from the CSV scan, or already typed from a table. Every
coercion is a native expression: bad input becomes NULL, never an error, and
NaN never survives (Spark orders NaN above every number, pandas treats it as missing).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import NA_TOKENS

# Java float suffixes that a plain cast accepts and the reference's parser does not,
# and the spellings of infinity that end in one of them.
_SUFFIXES = ("d", "D", "f", "F")
_INFINITIES = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")

# Date layouts accepted besides the ISO form that a plain cast understands; month and
# day may lack their zero, and a time of day may follow.
DATE_PATTERNS: tuple[str, ...] = ("yyyy/M/d[ H:m[:s]]", "yyyyMMdd")


def na_to_null(c: Column) -> Column:
    """The reader's missing-value tokens become NULL."""
    return F.when(c.isin(*NA_TOKENS), F.lit(None)).otherwise(c)


def nan_to_null(c: Column) -> Column:
    # nanvl names its input once; a CASE would repeat the whole parse expression.
    return F.nanvl(c, F.lit(None).cast("double"))


def to_double(c: Column, dtype: T.DataType | None = None) -> Column:
    """Numeric coercion with errors → NULL.

    Strings go through ``try_cast``; Spark alone also accepts Java float suffixes
    (``1.0d``, ``2f``), which the reference's parser rejects, so those are refused
    unless the cell spells infinity.
    """
    if dtype is not None and not isinstance(dtype, T.StringType):
        return nan_to_null(c.cast("double"))
    s = F.trim(c)
    suffixed = F.substring(s, -1, 1).isin(*_SUFFIXES) & ~F.lower(s).isin(*_INFINITIES)
    parsed = F.when(suffixed, F.lit(None).cast("double")).otherwise(s.try_cast("double"))
    return nan_to_null(parsed)


def to_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Date coercion with errors → NULL (ISO, ``yyyy/M/d`` with an optional time, ``yyyyMMdd``)."""
    if dtype is not None and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    s = F.trim(c.cast("string"))
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), s.try_cast("date"))
    others = [F.try_to_timestamp(s, F.lit(p)).cast("date") for p in DATE_PATTERNS]
    return F.coalesce(iso, *others)


def to_text(c: Column) -> Column:
    return na_to_null(c.cast("string"))
