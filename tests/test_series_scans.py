"""Scans over split series, as-of joins and dimension tables against pandas and unsplit plans."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith import contracts as K
from barsmith.operators import asof, dimensions
from barsmith.operators import factors as FX
from barsmith.operators.series import EWM_BLOCK, as_series
from barsmith.plans.catalog import _r6
from barsmith.plans.fixtures import history_bars, minute_bars, raw_bars, write_quote_files
from sf_paths import SF_SMALL

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def steps():
    """Series of several lengths with NULLs, one that begins with NULLs, one of NULLs only."""
    rng = np.random.default_rng(1)
    rows = []
    for code, n in (("a", 2000), ("b", 30), ("c", 1), ("d", 400), ("e", 12)):
        for i, v in enumerate(rng.normal(100, 20, n)):
            gone = rng.random() < 0.1 or (code == "d" and i < 20) or code == "e"
            rows.append((code, i, None if gone else float(v)))
    return pd.DataFrame(rows, columns=["code", "t", "x"])


def to_spark(spark, pdf, schema):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


@pytest.mark.parametrize("max_rows", [None, 100, 3])
def test_scans_match_pandas(spark, steps, max_rows):
    s = as_series(to_spark(spark, steps, "code string, t long, x double").repartition(5), "code", ["t"], F.col("t"), max_rows)
    assert s.segmented == (max_rows is not None)
    x = F.col("x")
    r = s.running(total=("sum", x), n=("count", x), top=("max", x), low=("min", x), known=("last", x)).lag("x", "before").lead("x", "after")
    h = r.ewm(fast=(x, 9), slow=(x, 26)).halo(6)
    last = h.local_window().rowsBetween(-6, 0)
    h = h.with_df(h.df.withColumns({"sum7": F.sum("x").over(last), "rows7": F.count(F.lit(1)).over(last)}))
    out = h.without_halo().df.toPandas().sort_values(["code", "t"]).reset_index(drop=True)
    assert len(out) == len(steps)
    for _, g in out.groupby("code"):
        v = g["x"].astype(float)
        want = {"n": v.notna().cumsum(), "known": v.ffill(), "top": v.ffill().cummax(), "low": v.ffill().cummin(),
                "total": v.cumsum().ffill(), "before": v.shift(1), "after": v.shift(-1), "sum7": v.rolling(7, min_periods=1).sum()}
        for span, name in ((9, "fast"), (26, "slow")):
            want[name] = v.dropna().ewm(span=span, adjust=False).mean().reindex(v.index).ffill()
        for name, w in want.items():
            np.testing.assert_allclose(g[name].astype(float), w.astype(float), rtol=1e-11, err_msg=name)
        assert (g["rows7"] == np.minimum(np.arange(len(g)) + 1, 7)).all()


def test_exponential_mean_of_a_long_series(spark):
    """More rows than a group of blocks holds, in several segments: every level of the scan is used."""
    n = EWM_BLOCK * EWM_BLOCK + 3000
    df = spark.range(n).select(F.lit("a").alias("code"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("x"))
    want = df.orderBy("t").toPandas()["x"].ewm(span=26, adjust=False).mean().to_numpy()
    for max_rows in (None, 40_000):
        s = as_series(df, "code", ["t"], F.col("t"), max_rows).ewm(y=(F.col("x"), 26))
        got = s.df.orderBy("t").toPandas()["y"].to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-11)
    assert s.df.select("_seg").distinct().count() > 1


def test_empty_series(spark):
    df = spark.createDataFrame([], "code string, t long, x double")
    s = as_series(df, "code", ["t"], F.col("t"), 10).running(n=("count", F.col("x"))).ewm(y=(F.col("x"), 9)).halo(3).without_halo()
    assert s.df.collect() == []


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_minute_factors_match_the_whole_series(spark):
    bars = minute_bars(spark, SF_SMALL).drop("volume", "amount", "open")
    for work in (FX.moving_averages_of, FX.atr_of, FX.drawdown_of):
        same(work(FX.minute_series(bars, 8)).df.drop("_seg"), work(FX.minute_series(bars)).df.drop("_seg"))


def test_macd_matches_pandas_and_splits(spark):
    bars = raw_bars(spark, SF_SMALL).select("code", "trade_date", "close")
    whole = FX.macd(bars).toPandas().sort_values(["code", "trade_date"]).reset_index(drop=True)
    split = FX.macd(bars, max_rows=50).toPandas().sort_values(["code", "trade_date"]).reset_index(drop=True)
    fast, slow, signal = FX.MACD_SPANS
    for _, g in whole.groupby("code"):
        line = g["close"].ewm(span=fast, adjust=False).mean() - g["close"].ewm(span=slow, adjust=False).mean()
        np.testing.assert_allclose(g["macd"], line, atol=1e-9)
        np.testing.assert_allclose(g["macd_signal"], line.ewm(span=signal, adjust=False).mean(), atol=1e-9)
    for c in ("macd", "macd_signal", "macd_hist"):
        np.testing.assert_allclose(split[c], whole[c], atol=1e-9)


# -- dimension tables ---------------------------------------------------------------------

def test_split_codes_give_the_same_dimensions(spark):
    bars = history_bars(spark, SF_SMALL).select("code", "trade_date", "name", "volume")
    calendar = dimensions.trade_calendar(bars).checkpoint()
    same(dimensions.name_history(bars, max_rows=40), dimensions.name_history(bars))
    same(dimensions.missing_sessions(bars, calendar, max_rows=40), dimensions.missing_sessions(bars, calendar))


def test_calendar_and_holes_by_hand(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [("a", day(0)), ("a", day(1)), ("a", day(400)), ("b", day(1)), ("b", day(9)), ("b", day(365)), ("c", day(9)), ("d", None)]
    bars = spark.createDataFrame(rows, "code string, trade_date date")
    cal = dimensions.trade_calendar(bars).checkpoint()
    got = [tuple(r) for r in cal.orderBy("trade_date").collect()]
    assert got == [(day(0), 1, None, None, 1), (day(1), 2, day(0), 1, 2), (day(9), 3, day(1), 8, 2), (day(365), 4, day(9), 356, 1), (day(400), 5, day(365), 35, 1)]
    holes = sorted((r["code"], r["session_no"], r["trade_date"]) for r in dimensions.missing_sessions(bars, cal).collect())
    assert holes == [("a", 3, day(9)), ("a", 4, day(365))]
    none = bars.limit(0)
    assert dimensions.trade_calendar(none).collect() == []
    assert dimensions.missing_sessions(none, dimensions.trade_calendar(none)).collect() == []


def test_name_history_by_hand(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [("a", day(0), "X", 1.0), ("a", day(1), "X", 2.0), ("a", day(2), "X", 0.0), ("a", day(3), "X", None), ("a", day(4), "STX", 1.0), ("a", day(7), "X", 1.0),
            ("b", day(1), None, 1.0), ("b", day(2), None, 1.0), ("b", day(3), "B退", 1.0)]
    bars = spark.createDataFrame(rows, "code string, trade_date date, name string, volume double")
    for max_rows in (None, 2):
        got = sorted(tuple(r) for r in dimensions.name_history(bars, max_rows).select("code", "version", "is_st", "suspended", "valid_from", "valid_to", "bars", "next_from", "is_current").collect())
        assert got == [("a", 1, False, False, day(0), day(1), 2, day(2), False), ("a", 2, False, True, day(2), day(3), 2, day(4), False),
                       ("a", 3, True, False, day(4), day(4), 1, day(7), False), ("a", 4, False, False, day(7), day(7), 1, None, True),
                       ("b", 1, False, False, day(1), day(2), 2, day(3), False), ("b", 2, False, False, day(3), day(3), 1, None, True)]
    info = {r["code"]: r for r in dimensions.stock_info(bars).collect()}
    assert (info["a"]["name"], info["a"]["suspended_days"], info["a"]["is_st"], info["b"]["delisting"]) == ("X", 2, False, True)


# -- as-of joins -----------------------------------------------------------------------------

@pytest.mark.parametrize("max_rows", [None, 12])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_matches_pandas(spark, max_rows, inclusive):
    rng = random.Random(7)
    day = lambda: DAY + dt.timedelta(rng.randrange(60))
    left = pd.DataFrame({"code": [rng.choice("aab") for _ in range(150)] + ["z"] * 3, "on": [day() for _ in range(153)], "i": range(153)})
    right = pd.DataFrame({"code": [rng.choice("aabq") for _ in range(40)], "at": [day() for _ in range(40)], "v": range(40)})
    out = asof.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "code", "on", "at", ["v"], inclusive=inclusive, max_rows=max_rows)
    got = {r["i"]: (r["at"], r["v"]) for r in out.collect()}
    assert len(got) == out.count() == 153
    for i, (code, on) in enumerate(zip(left["code"], left["on"])):
        known = [(at, v) for c, at, v in zip(right["code"], right["at"], right["v"]) if c == code and (at <= on if inclusive else at < on)]
        assert got[i] == max(known, default=(None, None))


def test_asof_odd_rows(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    left = spark.createDataFrame([("a", t(5), 1), ("a", t(12), 2), (None, t(5), 3), ("a", None, 4), ("b", t(1), 5)], "key string, t timestamp, at int")
    right = spark.createDataFrame([("a", t(4), 1.0), ("a", t(4), 2.0), (None, t(1), 9.0), ("a", None, 8.0), ("b", t(2), 7.0)], "key string, seen timestamp, v double")
    hour = 3_600_000_000
    got = {r["at"]: (r["seen"], r["v"]) for r in asof.asof_join(left, right, "key", "t", "seen", ["v"], tolerance=2 * hour).collect()}
    assert got == {1: (t(4), 2.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    none = asof.asof_join(left, right.limit(0), "key", "t", "seen", ["v"])
    assert none.count() == 5 and none.where("v IS NOT NULL").count() == 0
    assert asof.asof_join(left.limit(0), right, "key", "t", "seen", ["v"]).collect() == []


def test_valuation_knows_only_what_was_announced(spark):
    day = lambda n: DAY + dt.timedelta(n)
    bars = spark.createDataFrame([("a", day(i), 10.0) for i in range(12)], "code string, trade_date date, close double")
    reports = spark.createDataFrame([("a", day(2 * i + 1), e, b) for i, (e, b) in enumerate([(1.0, 5.0), (1.0, 0.0), (1.0, 4.0), (1.0, 2.0), (-9.0, 2.0)])],
                                    "code string, announced_on date, eps double, bps double")
    for max_rows in (None, 3):
        got = {(r["trade_date"] - DAY).days: (r["pe"], r["pb"]) for r in asof.valuation(bars, reports, max_rows).collect()}
        assert [got[i][0] for i in range(12)] == [None] * 7 + [2.5, 2.5] + [None] * 3
        assert [got[i][1] for i in range(12)] == [None, 2.0, 2.0, None, None, 2.5, 2.5] + [5.0] * 5


@pytest.mark.parametrize("max_rows", [None, 2])
def test_drawdown_of_series_that_begin_at_zero(spark, max_rows):
    closes = {"a": [0.0, 0.0, 2.0, 1.0], "b": [4.0, 0.0, 2.0], "c": [0.0, -1.0]}
    rows = [(c, DAY, i, v, v, v) for c, vs in closes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "code string, trade_date date, time int, high double, low double, close double")
    out = FX.drawdown_of(FX.minute_series(df, max_rows)).df.toPandas().sort_values(["code", "time"])
    for code, g in out.groupby("code"):
        v = np.array(closes[code])
        with np.errstate(divide="ignore", invalid="ignore"):
            np.testing.assert_array_equal(g["equity"], v / v[0])
            np.testing.assert_array_equal(g["drawdown"], 1.0 - v / np.maximum.accumulate(v))


def test_rounding_keeps_what_is_not_finite(spark):
    values = [1.2345675, -1.2345675, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(_r6(F.col("v"))).collect()]
    assert got[:2] == [1.234568, -1.234567] and got[2] == 1e300 and got[3] == -1e300 and got[4] == math.inf and got[5] == -math.inf
    assert math.isnan(got[6]) and got[7] is None


def test_macd_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(c, DAY + dt.timedelta(i), 10.0 + i % 7) for c in "ab" for i in range(600)]
    df = spark.createDataFrame(rows, "code string, trade_date date, close double").mapInPandas(counted, "code string, trade_date date, close double")
    assert FX.macd(df).count() == 1200
    assert seen.value == 1200


def test_quote_files_hold_the_lines_of_their_series(spark, tmp_path):
    days = [(k, DAY + dt.timedelta(i), f"c{k}", "甲\n乙" if k == 2 else "甲", float(i)) for k in (1, 2, None) for i in range(3)]
    bars = spark.createDataFrame(days, "k int, trade_date date, code string, name string, close double")
    std = [c for c in K.HEADER_MAP.values() if c not in bars.columns]
    bars = bars.withColumns({K.SRC: F.concat(F.lit("f"), F.col("k").cast("string")), **{c: F.lit(None).cast("double") for c in std}})
    (tmp_path / "out" / "series=old").mkdir(parents=True)
    (tmp_path / "out" / "series=old" / "part.csv").write_text("gone\n")
    write_quote_files(bars, str(tmp_path / "out"))
    found = {p.parent.name: p.read_bytes().decode("gbk").split("\n") for p in (tmp_path / "out").glob("*/*")}
    assert set(found) == {"series=f1", "series=f2", "series=__HIVE_DEFAULT_PARTITION__"}
    names = list(K.HEADER_MAP)
    assert found["series=f1"][:2] == ["数据来源: 测试", ",".join(reversed(names))] and len(found["series=f1"]) == 6 and found["series=f1"][-1] == ""
    assert found["series=f2"][1] == ",".join(names) and len(found["series=f2"]) == 9
    assert [line.split(",")[0] for line in found["series=f2"][2::2][:3]] == [str(DAY + dt.timedelta(i)) for i in range(3)]
