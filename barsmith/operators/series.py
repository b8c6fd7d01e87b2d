"""Ordered-series windows that stay balanced when one series is huge.

The cleaner works on series (one source file = one series) ordered by date. The
obvious plan, ``Window.partitionBy(src)``, sends a whole series to one task; a
source holding a third of all rows would then run on one core. Here every window
is partitioned by ``(src, seg)`` instead:

* ``seg`` is 0 for ordinary series. A *hot* series (more than ``max_rows`` rows)
  is cut into contiguous segments at approximate quantiles of its order key, so
  each segment is bounded.
* Position, lag and series-wide aggregates are computed inside each segment, then
  corrected by a small per-``(src, seg)`` table (counts, last values, partial
  aggregates) combined over the segments of the series and joined back on
  ``(src, seg)``. The big side is already hash-partitioned on exactly those keys,
  so the fix-up join does not shuffle it again.

Running values (sum, extremes, last known value), windows of the last ``n`` rows and
exponential means follow the same scheme: a running value takes the carry of the earlier
segments, a window takes copies of the ``n - 1`` rows before its segment (the *halo*), and
a linear recurrence is a scan of affine maps over blocks, groups of blocks and segments.

Without hot series nothing is joined: the plan is one exchange on ``(src, seg)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Bits reserved below the day number for the tie hash in the packed order key.
TIE_BITS = 22
DEFAULT_MAX_ROWS = 4_000_000
# Upper bound of segments per hot series (size of the boundary array).
MAX_SEGMENTS = 1024
# Hot-series boundaries are broadcast; refuse beyond this many bytes.
MAX_BOUNDARY_BYTES = 64 * 1024 * 1024
# Rows of a block, and blocks of a group, in the scan of an exponential mean.
EWM_BLOCK = 256


def packed_order_key(day: Column, tie_columns: list[Column]) -> Column:
    """``days_since_epoch << 22 | hash(ties) mod 2^22``: one sortable long per row.

    Equal dates are ordered by a hash of the tie columns (then by the columns
    themselves), which is deterministic and lets a percentile split a single
    busy date across segments.
    """
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    tie = F.pmod(F.xxhash64(*tie_columns), F.lit(1 << TIE_BITS))
    return days * F.lit(1 << TIE_BITS) + tie


@dataclass
class Series:
    """A frame of many series plus the layout used for every window over it."""

    df: DataFrame
    key: str
    order: list[str]
    segmented: bool = False
    seg: str = "_seg"

    # -- layout ---------------------------------------------------------------
    def local_window(self) -> Window:
        return Window.partitionBy(self.key, self.seg).orderBy(*self.order)

    def segment_window(self) -> Window:
        return Window.partitionBy(self.key, self.seg)

    def with_df(self, df: DataFrame) -> Series:
        return Series(df, self.key, self.order, self.segmented, self.seg)

    # -- operators ------------------------------------------------------------
    def position(self, name: str) -> Series:
        """1-based row number per series in ``order``."""
        local = F.row_number().over(self.local_window())
        if not self.segmented:
            return self.with_df(self.df.withColumn(name, local))
        df = self.df.withColumn(name, local)
        counts = df.groupBy(self.key, self.seg).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(self.key).orderBy(self.seg).rowsBetween(Window.unboundedPreceding, -1)
        offsets = _small(counts.select(self.key, self.seg,
                                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
        df = df.join(offsets, [self.key, self.seg], "left").withColumn(
            name, (F.col(name) + F.col("_off")).cast("int")).drop("_off")
        return self.with_df(df)

    def lag(self, column: str, name: str) -> Series:
        """Value of ``column`` on the previous row of the series (NULL on the first)."""
        w = self.local_window()
        local = F.lag(column).over(w)
        if not self.segmented:
            return self.with_df(self.df.withColumn(name, local))
        df = self.df.withColumn(name, local).withColumn("_first_in_seg", F.row_number().over(w) == 1)
        last = df.groupBy(self.key, self.seg).agg(
            F.max(F.struct(*[F.col(c) for c in self.order], F.col(column).alias("_v")))["_v"].alias("_last"))
        before = Window.partitionBy(self.key).orderBy(self.seg)  # every segment listed holds a row
        carry = _small(last.select(self.key, self.seg, F.lag("_last").over(before).alias("_carry")))
        df = (df.join(carry, [self.key, self.seg], "left")
              .withColumn(name, F.when(F.col("_first_in_seg"), F.col("_carry")).otherwise(F.col(name)))
              .drop("_first_in_seg", "_carry"))
        return self.with_df(df)

    def aggregate(self, **aggs: tuple[str, Column]) -> Series:
        """Series-wide aggregates attached to every row.

        Each value is ``(kind, expr)`` with kind ``min``, ``max`` or ``sum``:
        decomposable, so a hot series combines its segments' partials.
        ``max`` over a struct whose first field is the position gives "value at the
        last row"; ``max`` over a boolean is ``bool_or``.
        """
        fn = {"min": F.min, "max": F.max, "sum": F.sum}
        if not self.segmented:
            w = self.segment_window()
            return self.with_df(self.df.withColumns({n: fn[k](e).over(w) for n, (k, e) in aggs.items()}))
        part = self.df.groupBy(self.key, self.seg).agg(*[fn[k](e).alias(n) for n, (k, e) in aggs.items()])
        whole = Window.partitionBy(self.key)
        comb = _small(part.select(self.key, self.seg,
                                  *[fn[k](F.col(n)).over(whole).alias(n) for n, (k, _) in aggs.items()]))
        df = self.df.drop(*[n for n in aggs if n in self.df.columns]).join(comb, [self.key, self.seg], "left")
        return self.with_df(df)

    def running(self, **values: tuple[str, Column]) -> Series:
        """Values over all rows up to the current one.

        Each value is ``(kind, expr)`` with kind ``sum``, ``count``, ``min``, ``max`` or ``last``
        (the last one that is not NULL); all but ``count`` are NULL until a value is met.
        """
        upto = self.local_window().rowsBetween(Window.unboundedPreceding, 0)
        df = self.df.withColumns({n: _running(k, e).over(upto) for n, (k, e) in values.items()})
        if not self.segmented:
            return self.with_df(df)

        def whole(kind: str, e: Column) -> Column:
            if kind != "last":
                return _running(kind, e)
            return F.max(F.when(e.isNotNull(), F.struct(*[F.col(c) for c in self.order], e.alias("_v"))))["_v"]

        # The carried values stand beside the local ones, so they need names of their own.
        part = self.df.groupBy(self.key, self.seg).agg(*[whole(k, e).alias(f"_c_{n}") for n, (k, e) in values.items()])
        before = Window.partitionBy(self.key).orderBy(self.seg).rowsBetween(Window.unboundedPreceding, -1)
        carry = _small(part.select(self.key, self.seg, *[
            _running("sum" if k == "count" else k, F.col(f"_c_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in values.items()]))
        df = df.join(carry, [self.key, self.seg], "left").withColumns(
            {n: _combined(k, F.col(f"_c_{n}"), F.col(n)) for n, (k, _) in values.items()})
        return self.with_df(df.drop(*[f"_c_{n}" for n in values]))

    def halo(self, n: int) -> Series:
        """The series with copies of the ``n`` rows before each segment put into it, marked ``_halo``.

        A window over the current and up to ``n`` rows before it, taken in
        :meth:`local_window`, is right on every row that is not a copy; ``without_halo``
        drops the copies. A segment shorter than ``n`` passes on rows of the one before it too.
        """
        df = self.df.withColumn("_halo", F.lit(False))
        if not self.segmented:
            return self.with_df(df)
        sizes = self.df.groupBy(self.key, self.seg).agg(F.count(F.lit(1)).alias("_size"))
        # Every segment holds a row, so only the next n can be reached.
        after = Window.partitionBy(self.key).orderBy(self.seg).rowsBetween(1, n)
        following = F.collect_list(F.struct(F.col(self.seg).alias("to"), F.col("_size").alias("size"))).over(after)
        between = lambda i: F.aggregate(F.slice("_next", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["size"])
        reach = _small(sizes.withColumn("_next", following).withColumn(
            "_next", F.transform("_next", lambda x, i: F.struct(x["to"].alias("to"), between(i).alias("gap")))))
        from_end = F.col("_size") - F.row_number().over(self.local_window()) + 1
        rows = self.df.join(reach, [self.key, self.seg]).withColumn("_r", from_end).where(F.col("_r") <= n)
        copies = rows.withColumn("_to", F.explode(F.filter("_next", lambda x: x["gap"] + F.col("_r") <= n)["to"]))
        copies = copies.withColumn(self.seg, F.col("_to").cast(df.schema[self.seg].dataType)).withColumn("_halo", F.lit(True))
        return self.with_df(df.unionByName(copies.select(*df.columns)))

    def without_halo(self) -> Series:
        return self.with_df(self.df.where(~F.col("_halo")).drop("_halo"))

    def lead(self, column: str, name: str) -> Series:
        """Value of ``column`` on the next row of the series (NULL on the last)."""
        w = self.local_window()
        df = self.df.withColumn(name, F.lead(column).over(w))
        if not self.segmented:
            return self.with_df(df)
        df = df.withColumn("_last_in_seg", F.lead(F.lit(1)).over(w).isNull())
        first = self.df.groupBy(self.key, self.seg).agg(
            F.min(F.struct(*[F.col(c) for c in self.order], F.col(column).alias("_v")))["_v"].alias("_first"))
        after = Window.partitionBy(self.key).orderBy(self.seg)
        carry = _small(first.select(self.key, self.seg, F.lead("_first").over(after).alias("_carry")))
        df = (df.join(carry, [self.key, self.seg], "left")
              .withColumn(name, F.when(F.col("_last_in_seg"), F.col("_carry")).otherwise(F.col(name)))
              .drop("_last_in_seg", "_carry"))
        return self.with_df(df)

    def ewm(self, **means: tuple[Column, int]) -> Series:
        """Exponential means, each ``(value, span)``: ``y = x`` on the first value, then ``y = (1 - alpha) y + alpha x``, ``alpha = 2 / (span + 1)``.

        A NULL leaves the mean as it is (NULL before the first value). The recurrence is a
        scan of affine maps ``y -> a y + b``: prefix sums inside blocks of ``EWM_BLOCK`` rows,
        whose maps are composed within groups of as many blocks, the groups within the
        segment and the segments within the series. Each of these tables is that many times
        smaller, and no step holds more than one group of maps, however long the series is.
        """
        keys, names = [self.key, self.seg], list(means)
        s = self.with_df(self.df.withColumns({f"_x_{n}": v.cast("double") for n, (v, _) in means.items()}))
        s = s.running(**{f"_k_{n}": ("count", F.col(f"_x_{n}")) for n in names})
        df = s.df.withColumn("_blk", F.floor((F.row_number().over(s.local_window()) - 1) / EWM_BLOCK))
        inside = Window.partitionBy(*keys, "_blk").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_m_{n}": F.count(f"_x_{n}").over(inside).cast("double") for n in names})
        maps = {}
        for n, (_, span) in means.items():
            alpha = 2.0 / (span + 1)
            x, m, keep = F.col(f"_x_{n}"), F.col(f"_m_{n}"), F.lit(1.0 - alpha)
            # The first value enters whole. Weights are relative to the start of the block, where
            # (1 - alpha) ** -EWM_BLOCK stays far below the largest double.
            given = F.when(F.col(f"_k_{n}") == 1, x).otherwise(x * alpha)
            total = F.coalesce(F.sum(given * F.pow(keep, -m)).over(inside), F.lit(0.0))
            maps[f"_y_{n}"] = F.struct(F.pow(keep, m).alias("a"), (total * F.pow(keep, m)).alias("b"))
        df = df.withColumns(maps)
        # The map of a block is the one at its last row.
        ys = [f"_y_{n}" for n in names]
        last = F.max(F.struct(*[F.col(c) for c in self.order], *ys))
        blocks = (df.groupBy(*keys, "_blk").agg(last.alias("_l")).select(*keys, "_blk", *[F.col(f"_l.{y}").alias(y) for y in ys])
                  .withColumn("_grp", F.floor(F.col("_blk") / EWM_BLOCK)))
        blocks = _small(_with_prefix(blocks, [*keys, "_grp"], "_blk", ys))
        groups = _small(_with_prefix(_whole_maps(blocks, [*keys, "_grp"], "_blk", ys), keys, "_grp", ys))
        parts = _with_prefix(_whole_maps(groups, keys, "_grp", ys), [self.key], self.seg, ys)

        def before(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
            return df.select(*columns, *[F.col(f"_p{y}").alias(prefix + y) for y in ys])

        into = (before(parts, "s", *keys).join(before(groups, "g", *keys, "_grp"), keys)
                .join(before(blocks, "b", *keys, "_grp", "_blk"), [*keys, "_grp"]))
        # What a block starts from: the series' value before its segment, passed through the maps between.
        start = {f"_v{y}": F.col(f"b{y}.a") * (F.col(f"g{y}.a") * F.col(f"s{y}.b") + F.col(f"g{y}.b")) + F.col(f"b{y}.b") for y in ys}
        into = _small(into.select(*keys, "_blk", *[c.alias(n) for n, c in start.items()]))
        out = df.join(into, [*keys, "_blk"], "left").withColumns({
            n: F.when(F.col(f"_k_{n}") > 0, F.col(f"_y_{n}.a") * F.col(f"_v_y_{n}") + F.col(f"_y_{n}.b")) for n in names})
        return self.with_df(out.drop("_blk", *[f"{p}_{n}" for n in names for p in ("_x", "_k", "_m", "_y", "_v_y")]))


def _running(kind: str, e: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind](e)


def _combined(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    return {"min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}[kind](carry, local)


def _compose(maps: Column) -> Column:
    """The map of applying ``maps`` (structs ``a``, ``b``) one after the other."""
    first = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, first, lambda acc, x: F.struct((x["a"] * acc["a"]).alias("a"), (x["a"] * acc["b"] + x["b"]).alias("b")))


def _with_prefix(df: DataFrame, group: list[str], order: str, maps: list[str]) -> DataFrame:
    """``df`` with ``_p<map>``, the composed map of the rows before each one in its group."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"_p{m}": _compose(F.collect_list(m).over(before)) for m in maps})


def _whole_maps(df: DataFrame, group: list[str], order: str, maps: list[str]) -> DataFrame:
    """One map a group of a frame that :func:`_with_prefix` gave."""
    last = df.groupBy(*group).agg(F.max(F.struct(order, *[f"_p{m}" for m in maps], *maps)).alias("_l"))
    return last.select(*group, *[F.struct((F.col(f"_l.{m}.a") * F.col(f"_l._p{m}.a")).alias("a"),
                                          (F.col(f"_l.{m}.a") * F.col(f"_l._p{m}.b") + F.col(f"_l.{m}.b")).alias("b")).alias(m) for m in maps])


def as_series(df: DataFrame, key: str, order: list[str], order_key: Column, max_rows: int | None = None) -> Series:
    """``df`` as series of ``key`` in ``order``, the ones beyond ``max_rows`` rows in segments.

    ``order_key`` is a number that grows with ``order`` (equal numbers are kept in one
    segment's order by ``order`` itself, so it must be as fine as ``order``). Without
    ``max_rows`` no series is split and nothing is counted.
    """
    if max_rows is None:
        return Series(df.withColumn("_seg", F.lit(0)), key, order)
    split, segmented = plan_segments(df.withColumn("_okey", order_key), key, "_okey", max_rows)
    return Series(split.drop("_okey"), key, order, segmented)


def _small(df: DataFrame) -> DataFrame:
    """Materialize a per-segment fix-up table (one row per ``(src, seg)``).

    Later stages join several of these; checkpointing each keeps the plan linear
    (one scan of the big frame per stage) instead of re-deriving every earlier
    fix-up inside each later one.
    """
    return df.checkpoint(eager=True)


def plan_segments(df: DataFrame, key: str, order_key: str, max_rows: int = DEFAULT_MAX_ROWS,
                  seg: str = "_seg", counts: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Add the segment column; returns the frame and whether any series was split.

    Runs one aggregation (rows per series, partially aggregated before the
    shuffle; or ``counts`` given as ``(key, _n)`` upper bounds, e.g. from file
    sizes) and collects only two numbers. Boundaries are computed for hot series
    alone and broadcast; their size is at most ``rows / max_rows * MAX_SEGMENTS``
    longs and is checked before the broadcast. When a series is split, the frame
    is hash-partitioned on ``(key, seg)`` and checkpointed to the shared
    checkpoint folder, so the fix-up joins read it instead of recomputing it.
    """
    if counts is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > max_rows)
    stats = hot.agg(F.count(F.lit(1)).alias("k"), F.max("_n").alias("m")).first()
    n_hot, biggest = int(stats["k"] or 0), int(stats["m"] or 0)
    if n_hot == 0:
        return df.withColumn(seg, F.lit(0)), False
    pieces = 1
    while pieces < MAX_SEGMENTS and pieces * max_rows < 2 * biggest:
        pieces *= 2
    if n_hot * pieces * 8 > MAX_BOUNDARY_BYTES:
        raise ValueError(f"{n_hot} hot series x {pieces} segments exceed the boundary budget; raise max_rows")
    grid = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    bounds = (df.join(F.broadcast(hot.select(key)), key, "left_semi")
              .groupBy(key).agg(F.percentile_approx(order_key, grid, 10_000).alias("_b")))
    # A value that fills several quantile cuts (e.g. one row copied millions of
    # times) spreads over the segments between its equal cuts: they hold nothing
    # else, so order stays contiguous, and rows that share the whole order key are
    # interchangeable (identical up to a hash collision), so any split of them is fine.
    below = F.size(F.filter("_b", lambda b: b < F.col(order_key)))
    equal = F.size(F.filter("_b", lambda b: b == F.col(order_key)))
    spread = F.when(equal > 1, F.pmod(F.monotonically_increasing_id(), equal)).otherwise(F.lit(0))
    out = (df.join(F.broadcast(bounds), key, "left")
           .withColumn(seg, F.when(F.col("_b").isNull(), F.lit(0)).otherwise(below + spread))
           .drop("_b"))
    checkpoint_dir(df.sparkSession)
    return out.repartition(key, seg).checkpoint(eager=True), True


def split_hot(df: DataFrame, key: str, order_key: str, max_rows: int = DEFAULT_MAX_ROWS,
              seg: str = "_seg", counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Separate ordinary series from hot ones: ``(cold, hot)``.

    ``cold`` keeps every series with at most ``max_rows`` rows (``seg`` = 0) and
    is cut from the input by an anti-join with the broadcast list of hot keys,
    so it keeps its partitioning and takes the single-exchange plan. ``hot``
    holds the split series, segmented and checkpointed as in
    :func:`plan_segments`, or is ``None`` when there are none; only these rows
    pay for the segment fix-ups.
    """
    if counts is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > max_rows).select(key, "_n")
    stats = hot.agg(F.count(F.lit(1)).alias("k")).first()
    if int(stats["k"] or 0) == 0:
        return df.withColumn(seg, F.lit(0)), None
    hot_keys = F.broadcast(hot.select(key))
    cold = df.join(hot_keys, key, "left_anti").withColumn(seg, F.lit(0))
    hot_rows = df.join(hot_keys, key, "left_semi")
    split, _ = plan_segments(hot_rows, key, order_key, max_rows, seg, counts=hot)
    return cold, split
