"""As-of joins and point-in-time factors.

``asof_join`` gives every row of the left frame the last row of the right one that was
known at its time. Both are put into one frame and ordered by time, and the last known
right row is carried forward as a running value of a :class:`Series`: one exchange by key,
no range join, and a key with more than ``max_rows`` rows is cut into segments with a carry
between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import as_series


def _moment(c: Column, dtype: T.DataType) -> Column:
    """A time as a whole number that keeps its order: days, microseconds or the number itself."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    return c.cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], *,
              tie: list[str] | None = None, inclusive: bool = True, tolerance: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of ``left`` with ``columns`` and ``right_time`` of the latest right row not after their time.

    Of right rows with one key and time the greatest by ``tie`` (by ``columns`` if not given)
    stands. ``inclusive=False`` takes rows before the time only; ``tolerance`` (days, or
    microseconds for timestamps) blanks matches that are older. Left rows without a match
    keep NULLs; left rows with a NULL key or time match nothing; right rows with one are unused.
    """
    lt, rt = _moment(F.col(left_time), left.schema[left_time].dataType), _moment(F.col(right_time), right.schema[right_time].dataType)
    by = [F.col(c) for c in (tie or columns)]
    known = (right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).groupBy(key, right_time)
             .agg(F.max(F.struct(*by, F.struct(*columns).alias("_c")))["_c"].alias("_c")))
    payload = F.struct(F.col(right_time).alias(right_time), *[F.col(f"_c.{c}").alias(c) for c in columns])
    rights = known.select(F.col(key).alias("_key"), rt.alias("_t"), F.lit(0 if inclusive else 1).alias("_side"),
                          payload.alias("_right"), rt.alias("_known_at"))
    lefts = left.select(F.col(key).alias("_key"), lt.alias("_t"), F.lit(1 if inclusive else 0).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    joinable = F.col("_key").isNotNull() & F.col("_t").isNotNull()
    both = lefts.where(joinable).unionByName(rights, allowMissingColumns=True)
    s = as_series(both, "_key", ["_t", "_side"], F.col("_t") * 2 + F.col("_side"), max_rows)
    s = s.running(_last=("last", F.when(F.col("_right").isNotNull(), F.struct("_known_at", "_right"))))
    found = s.df.where(F.col("_left").isNotNull())
    match = F.col("_last._right")
    if tolerance is not None:
        match = F.when(F.col("_t") - F.col("_last._known_at") <= tolerance, match)
    taken = [right_time, *columns]
    out = found.withColumn("_m", match).select("_left.*", *[F.col(f"_m.{c}").alias(c) for c in taken])
    none = left.where(F.col(key).isNull() | F.col(left_time).isNull())
    return out.unionByName(none.select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in taken]))


def trailing_sum(reports: DataFrame, key: str, order: str, column: str, name: str, periods: int = 4, max_rows: int | None = None) -> DataFrame:
    """``reports`` with the sum of the last ``periods`` reports of a key (NULL until there are that many)."""
    s = as_series(reports, key, [order], F.unix_date(order), max_rows).halo(periods - 1)
    last = s.local_window().rowsBetween(-(periods - 1), 0)
    full = F.when(F.count(column).over(last) == periods, F.sum(column).over(last))
    return s.with_df(s.df.withColumn(name, full)).without_halo().df.drop(s.seg)


def valuation(bars: DataFrame, reports: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``pe`` and ``pb`` of every bar from the reports known on that day.

    ``reports`` has one row per ``(code, announced_on)`` with ``eps`` (a quarter's earnings per
    share) and ``bps`` (book value per share). PE is the close over the earnings of the last four
    reports, PB the close over the latest book value; each is NULL where its divisor is missing or not positive.
    """
    known = trailing_sum(reports, "code", "announced_on", "eps", "eps_ttm", max_rows=max_rows)
    out = asof_join(bars, known, "code", "trade_date", "announced_on", ["eps_ttm", "bps"], max_rows=max_rows)
    return out.withColumns({"pe": F.when(F.col("eps_ttm") > 0, F.col("close") / F.col("eps_ttm")),
                            "pb": F.when(F.col("bps") > 0, F.col("close") / F.col("bps"))})
