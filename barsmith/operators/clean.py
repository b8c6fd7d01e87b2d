"""The daily-bar cleaner (operators C1-C14, F1-F6, W1-W8, A1-A2, P3/P4, quarantine).

One lazy plan for all sources at once. A series is the rows of one source,
ordered by trade date; every window runs over ``(src, seg)`` from
:mod:`barsmith.operators.series`, so all of them share a single exchange and a
huge source is split instead of landing on one task.

Order of the rules (each bullet is one stage of the reference's cleaner):

1. coerce types (C1-C3) and drop rows without date or code (F1);
2. number the rows of each series by date (W1) — the number survives later
   drops, so it has gaps (W4 ``trading_days``);
3. drop rows with a null price or volume (F2), non-positive prices or negative
   volume (F3);
4. ``pct_change`` from ``pre_close`` if the series has any (A1, C4), else from
   the previous surviving close (W2); a first row with a zero change is repaired
   from its open (W3) — but only when it is row 1; otherwise the reference fails
   the source, which becomes quarantine reason ``first_row_dropped``;
5. turnover and average price (C5, C6) where their inputs exist;
6. keep rows within the board's limit + 0.02, and always row 1 (C11, F4, W5);
7. delisting: if the last kept row's name marks delisting and its amount is 0,
   cut the series after the last non-zero amount, or drop it if all are 0 (F5).

Failures of the reference (exceptions inside a source's pipeline or its save)
become per-source quarantine reasons instead of errors; see ``REASONS``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts as K
from ..functions import coerce, rules
from .adapt import to_standard_frame
from .series import DEFAULT_MAX_ROWS, Series, packed_order_key, plan_segments, split_hot

# Quarantine reasons, in priority order (the first that applies is reported).
REASONS: tuple[str, ...] = (
    "missing_column", "first_row_dropped", "type_guess", "last_name_null",
    "duplicate_key", "too_long", "numeric_overflow",
)

OUTPUT_COLUMNS: tuple[str, ...] = (K.SRC,) + K.STANDARD_COLUMNS + K.DERIVED_COLUMNS

# Stored columns that a source may lack, with the input columns each one needs. A
# source without them must leave the stored value of a matched key alone.
OPTIONAL_INPUTS: dict[str, tuple[str, ...]] = {
    **{c: (c,) for c in K.STANDARD_COLUMNS if c not in K.REQUIRED_COLUMNS},
    "turnover_rate": ("amount", "circulation_market_value"),
    "avg_price": ("amount", "volume"),
}
# Column of the cleaned rows that says whether a row's source delivered the value.
PRESENT: dict[str, str] = {c: f"present_{c}" for c in OPTIONAL_INPUTS}

# Stored decimal type of each numeric output column (for the overflow check).
_DECIMALS: dict[str, T.DecimalType] = {f.name: f.dataType for f in K.DAILY_SCHEMA.fields
                                       if isinstance(f.dataType, T.DecimalType)}


def _overflow_bound(dt: T.DecimalType) -> float:
    """Smallest magnitude whose half-up rounding to ``dt``'s scale no longer fits its precision.

    Comparing doubles with it gives the same verdict as a decimal cast, without
    building a decimal per cell.
    """
    return float(Decimal(10) ** (dt.precision - dt.scale) - Decimal("0.5") * Decimal(10) ** (-dt.scale))


def _flag(c: str) -> Column:
    return F.col(K.presence_flag(c))


def coerce_types(df: DataFrame) -> DataFrame:
    """C1-C3 on a standard frame: dates, doubles, NA tokens; presence flags kept."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {
        "trade_date": coerce.to_date(F.col("trade_date"), types["trade_date"]),
        "code": coerce.to_text(F.col("code")),
        "name": coerce.to_text(F.col("name")),
    }
    for c in K.NUMERIC_COLUMNS:
        out[c] = coerce.to_double(F.col(c), types[c])
    return df.withColumns(out)


def standardize(df: DataFrame, key: str = K.SRC) -> DataFrame:
    """Adapt (P1, P2) and coerce (C1-C3) any bar-shaped frame."""
    return coerce_types(to_standard_frame(df, key))


def _order_columns() -> list[str]:
    return ["_okey", "code", "name", "open", "high", "low", "close", "pre_close",
            "volume", "amount", "circulation_market_value", "total_market_value"]


def _identified(df: DataFrame) -> DataFrame:
    """rows with date and code (of sources carrying every required column), with the order key."""
    missing = F.lit(False)
    for c in K.REQUIRED_COLUMNS:
        missing = missing | ~_flag(c)
    kept = df.filter(F.col("trade_date").isNotNull() & F.col("code").isNotNull() & ~missing)
    return kept.withColumn("_okey", packed_order_key(F.col("trade_date"), [F.col("code")]))


def position(df: DataFrame, max_series_rows: int = DEFAULT_MAX_ROWS, counts: DataFrame | None = None) -> Series:
    """F1 + W1: rows with date and code, numbered per series by date (``pos``)."""
    kept, segmented = plan_segments(_identified(df), K.SRC, "_okey", max_series_rows, counts=counts)
    return Series(kept, K.SRC, _order_columns(), segmented).position("pos")


def valid(s: Series) -> Series:
    """F2 + F3: complete and positive prices, non-negative volume."""
    ok = F.lit(True)
    for c in K.PRICE_COLUMNS:
        ok = ok & F.col(c).isNotNull()
    ok = ok & (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0) & (
        F.col("volume") >= 0)
    return s.with_df(s.df.filter(ok))


def derive(s: Series, quarantine_first_row_dropped: bool = True) -> Series:
    """A1, W2, C4, W3, C5, C6, W4 and the limit flag of C11/F4 (``keep4``)."""
    s = s.aggregate(
        _has_pc=("max", F.col("pre_close").isNotNull()),
        _first=("min", F.struct(F.col("pos").alias("pos"), F.col("close").alias("close"),
                                F.col("pre_close").alias("pre_close"))),
    ).lag("close", "_prev_close")
    first = F.col("_first")
    pct0 = F.when(F.col("_has_pc"), rules.pct_from_pre_close(F.col("close"), F.col("pre_close"))).otherwise(
        rules.pct_from_lag(F.col("close"), F.col("_prev_close")))
    first_pct0 = F.when(F.col("_has_pc"), rules.pct_from_pre_close(first["close"], first["pre_close"])).otherwise(
        F.lit(0.0))
    first_dropped = (first["pos"] != 1) & (first_pct0 == 0)
    repair = (F.col("pos") == 1) & (F.col("_pct0") == 0)
    df = (s.df.withColumn("_pct0", pct0)
          .withColumn("pct_change", F.when(repair, F.col("close") / F.col("open") - 1.0).otherwise(F.col("_pct0")))
          .withColumn("turnover_rate", F.when(_flag("amount") & _flag("circulation_market_value"),
                                              rules.turnover_rate(F.col("amount"),
                                                                  F.col("circulation_market_value"))))
          .withColumn("avg_price", F.when(_flag("amount") & _flag("volume"),
                                          rules.avg_price(F.col("amount"), F.col("volume"), F.col("close"))))
          .withColumn("trading_days", F.col("pos").cast("int"))
          .withColumn("price_limit_threshold", rules.limit_threshold(
              F.col("code"), F.col("name"), F.col("trade_date"), _flag("name")))
          .withColumn("keep4", rules.within_limit(F.col("pct_change"), F.col("price_limit_threshold"), F.col("pos")))
          .withColumn("_reason", F.when(F.lit(quarantine_first_row_dropped) & first_dropped,
                                        F.lit("first_row_dropped")))
          .withColumnRenamed("_has_pc", "pct_from_pre_close")
          .drop("_pct0", "_prev_close", "_first"))
    return s.with_df(df)


def delist(s: Series) -> Series:
    """F5 (with A2, W6-W8): the ``keep`` flag after delisting truncation."""
    k4 = F.col("keep4")
    s = s.aggregate(
        _last=("max", F.when(k4, F.struct(F.col("pos").alias("pos"), F.col("name").alias("name"),
                                          F.col("amount").alias("amount")))),
        _end=("max", F.when(k4 & ~F.col("amount").eqNullSafe(0.0), F.col("trade_date"))),
    )
    last = F.col("_last")
    applies = _flag("name") & _flag("amount") & last.isNotNull()
    delisted = applies & rules.delist_name(last["name"]) & last["amount"].eqNullSafe(0.0)
    keep = k4 & (~delisted | F.coalesce(F.col("trade_date") <= F.col("_end"), F.lit(False)))
    reason = F.coalesce(F.col("_reason"), F.when(applies & last["name"].isNull(), F.lit("last_name_null")))
    return s.with_df(s.df.withColumn("keep", keep).withColumn("_reason", reason).drop("_last", "_end"))


def save_checks(s: Series) -> Series:
    """Per-source reasons the stored table would reject.

    Duplicate keys are counted by a window over ``(src, seg, _okey, code)``: the
    order key packs the date with a hash of the code, so this groups exactly the
    rows of one code and date, and it is a prefix of the order every other window
    sorts by — no new exchange and no new sort. Equal keys can straddle two
    segments only in a split series; :class:`CleanResult` checks that case separately.
    """
    k = F.col("keep") & F.col("_reason").isNull()
    overflow = F.lit(False)
    for c, dt in _DECIMALS.items():
        overflow = overflow | F.coalesce(F.abs(F.col(c)) >= F.lit(_overflow_bound(dt)), F.lit(False))
    same_key = Window.partitionBy(s.key, s.seg, "_okey", "code")
    df = s.df.withColumn("_dup", k & (F.sum(F.when(k, 1).otherwise(0)).over(same_key) > 1))
    s = s.with_df(df).aggregate(
        _dupkey=("max", F.col("_dup")),
        _long=("max", k & rules.too_long(F.col("code"), F.col("name"))),
        _overflow=("max", k & overflow),
    )
    reason = F.coalesce(F.col("_reason"), F.when(F.col("_dupkey"), F.lit("duplicate_key")),
                        F.when(F.col("_long"), F.lit("too_long")),
                        F.when(F.col("_overflow"), F.lit("numeric_overflow")))
    return s.with_df(s.df.withColumn("_reason", reason).drop("_dup", "_dupkey", "_long", "_overflow"))


@dataclass
class CleanResult:
    """Marked rows of every source plus the two views a job consumes."""

    standard: DataFrame  # adapted + coerced input, before F1
    marked: DataFrame    # F3 survivors with derived columns, ``keep`` and ``_reason``
    segmented: bool = False
    split_marked: DataFrame | None = None  # the part of ``marked`` that came from split series
    not_text: DataFrame | None = None  # sources whose text columns a guessing reader takes for numbers or nothing

    def _type_failures(self) -> DataFrame | None:
        """Sources that fail at the string rules: they have rows left by then, and no text."""
        if self.not_text is None:
            return None
        return self.marked.select(K.SRC).distinct().join(self.not_text, K.SRC, "left_semi")

    def _cross_segment_duplicates(self) -> DataFrame | None:
        """Split series only: keys stored twice across segments (partial aggregation first)."""
        if not self.segmented:
            return None
        part = self.split_marked if self.split_marked is not None else self.marked
        kept = part.filter(F.col("keep") & F.col("_reason").isNull())
        return (kept.groupBy(K.SRC, "code", "trade_date").agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > 1).select(K.SRC).distinct())

    def quarantine(self, presence: DataFrame | None = None) -> DataFrame:
        """One row per failed source: ``(src, reason)``.

        ``presence`` (``src`` + presence flags, one row per source, e.g. from the
        CSV headers) saves a pass over the rows to find sources missing a column.
        """
        missing = F.lit(False)
        for c in K.REQUIRED_COLUMNS:
            missing = missing | ~_flag(c)
        base = presence if presence is not None else self.standard
        allq = (base.filter(missing).select(K.SRC).distinct()
                .withColumn("reason", F.lit("missing_column"))
                .unionByName(self.marked.filter(F.col("_reason").isNotNull())
                             .groupBy(K.SRC).agg(F.first("_reason").alias("reason"))))
        extra = self._cross_segment_duplicates()
        if extra is not None:
            allq = allq.unionByName(extra.withColumn("reason", F.lit("duplicate_key")))
        guessed = self._type_failures()
        if guessed is not None:
            allq = allq.unionByName(guessed.withColumn("reason", F.lit("type_guess")))
        rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
        return (allq.groupBy(K.SRC).agg(F.min(F.struct(rank.alias("r"), F.col("reason").alias("reason")))
                                       ["reason"].alias("reason")))

    def clean(self, presence: bool = False) -> DataFrame:
        """Rows to store: kept rows of sources without any reason.

        With ``presence``, every column of :data:`PRESENT` follows: false where the
        row's source lacks the inputs of that stored column.
        """
        kept = self.marked.filter(F.col("keep") & F.col("_reason").isNull())
        extra = self._cross_segment_duplicates()
        if extra is not None:
            kept = kept.join(extra, K.SRC, "left_anti")
        if self.not_text is not None:
            kept = kept.join(self.not_text, K.SRC, "left_anti")
        flags = [functools.reduce(lambda a, b: a & b, [_flag(i) for i in inputs]).alias(PRESENT[c])
                 for c, inputs in OPTIONAL_INPUTS.items()] if presence else []
        return kept.select(*OUTPUT_COLUMNS, *flags)


def clean_bars(df: DataFrame, *, max_series_rows: int = DEFAULT_MAX_ROWS,
               quarantine_first_row_dropped: bool = True, standardized: bool = False,
               counts: DataFrame | None = None, not_text: DataFrame | None = None) -> CleanResult:
    """Run the whole cleaner over bars of any number of sources (column ``src``).

    ``counts`` (``src, _n``: upper bounds of rows per series, e.g. from file
    sizes) replaces the counting pass that finds series to split. ``not_text`` (``src``)
    names sources that fail with ``type_guess`` if any row of theirs reaches the string rules.
    """
    std = df if standardized else standardize(df)
    cold, hot = split_hot(_identified(std), K.SRC, "_okey", max_series_rows, counts=counts)

    def chain(frame: DataFrame, segmented: bool) -> DataFrame:
        s = Series(frame, K.SRC, _order_columns(), segmented).position("pos")
        return save_checks(delist(derive(valid(s), quarantine_first_row_dropped))).df

    marked = chain(cold, False)
    if hot is None:
        return CleanResult(std, marked, not_text=not_text)
    split = chain(hot, True)
    return CleanResult(std, marked.unionByName(split), segmented=True, split_marked=split, not_text=not_text)
