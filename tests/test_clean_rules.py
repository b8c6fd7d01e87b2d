"""Edge cases of the cleaning rules on hand-made series (FIXTURES.md §6)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barsmith import contracts as K
from barsmith.functions import rules
from barsmith.operators.clean import clean_bars

DEFAULT = dict(code="sh600000", name="Co", open=10.0, high=11.0, low=9.0, close=10.0, pre_close=10.0,
               volume=100.0, amount=1000.0, circulation_market_value=1e6, total_market_value=2e6)


def bars(spark, rows, src="s1", start=dt.date(2021, 1, 4), drop=()):
    out = []
    for i, r in enumerate(rows):
        v = dict(DEFAULT, **r)
        v.setdefault("trade_date", start + dt.timedelta(days=i))
        out.append(tuple([src] + [v.get(f.name) for f in K.BAR_SCHEMA.fields[1:]]))
    df = spark.createDataFrame(out, K.BAR_SCHEMA)
    return df.drop(*drop) if drop else df


def run(df, **kw):
    res = clean_bars(df, **kw)
    rows = sorted(res.clean().collect(), key=lambda r: r["trade_date"])
    q = {r["src"]: r["reason"] for r in res.quarantine().collect()}
    return rows, q


def test_limit_tolerance(spark):
    rows, _ = run(bars(spark, [{}, {"close": 11.2}, {"close": 11.201}]))
    assert [r["trading_days"] for r in rows] == [1, 2]


def test_first_row_exempt(spark):
    rows, _ = run(bars(spark, [{"close": 15.0}, {"close": 15.0, "pre_close": 15.0}]))
    assert rows[0]["pct_change"] == pytest.approx(0.5) and len(rows) == 2


def test_first_row_repair(spark):
    rows, _ = run(bars(spark, [{"close": 10.5, "pre_close": 10.5, "open": 10.0}]))
    assert rows[0]["pct_change"] == pytest.approx(0.05)


def test_first_row_dropped_quarantines(spark):
    df = bars(spark, [{"open": -1.0, "pre_close": None}, {"pre_close": None}, {"pre_close": None}])
    rows, q = run(df)
    assert rows == [] and q == {"s1": "first_row_dropped"}
    rows, q = run(df, quarantine_first_row_dropped=False)
    assert len(rows) == 2 and q == {}


def test_gap_in_ordinal(spark):
    rows, _ = run(bars(spark, [{}, {"volume": None}, {}, {}]))
    assert [r["trading_days"] for r in rows] == [1, 3, 4]


def test_lag_taken_before_limit_filter(spark):
    df = bars(spark, [{"pre_close": None, "close": 10.0}, {"pre_close": None, "close": 10.1},
                      {"pre_close": None, "close": 13.736}, {"pre_close": None, "close": 10.2}])
    rows, _ = run(df)
    assert [r["close"] for r in rows] == [10.0, 10.1]


def test_threshold_by_board(spark):
    cases = [("sh600001", "ST甲", "2021-01-04", 0.05), ("sh680001", "ST甲", "2021-01-04", 0.20),
             ("sz300001", "ST甲", "2020-08-23", 0.05), ("sz300001", "ST甲", "2020-08-24", 0.20),
             ("bj830001", "ST甲", "2021-01-04", 0.05), ("sz300001", "甲", "2020-08-23", 0.10),
             ("sz300001", "甲", "2020-08-24", 0.20), ("bj830001", "甲", "2021-01-04", 0.30),
             ("sh600001", None, "2021-01-04", 0.10)]
    df = spark.createDataFrame([(c, n, d) for c, n, d, _ in cases], "code string, name string, d string")
    got = df.select(rules.limit_threshold(F.col("code"), F.col("name"), F.col("d").cast("date"),
                                          F.lit(True)).alias("t")).collect()
    assert [r["t"] for r in got] == [e for *_, e in cases]


def test_pre_close_zero_or_null(spark):
    rows, _ = run(bars(spark, [{}, {"pre_close": 0.0, "close": 10.5}, {"pre_close": None, "close": 10.6}]))
    assert [r["pct_change"] for r in rows[1:]] == [0.0, 0.0]


def test_volume_zero_avg_price(spark):
    rows, _ = run(bars(spark, [{"volume": 0.0, "amount": 0.0, "close": 10.0}]))
    assert rows[0]["avg_price"] == 10.0


def test_delisted_tail_cut(spark):
    rows, q = run(bars(spark, [{"amount": 5.0}, {"amount": 0.0}, {"amount": 0.0, "name": "退市甲"}]))
    assert len(rows) == 1 and q == {}


def test_delisted_all_zero(spark):
    rows, q = run(bars(spark, [{"amount": 0.0}, {"amount": 0.0, "name": "退市甲"}]))
    assert rows == [] and q == {}


def test_delisted_null_amount_counts_as_nonzero(spark):
    rows, _ = run(bars(spark, [{"amount": 5.0}, {"amount": None}, {"amount": 0.0, "name": "甲退"}]))
    assert len(rows) == 2


def test_capital_s_is_delisted(spark):
    rows, _ = run(bars(spark, [{"amount": 5.0}, {"amount": 0.0, "name": "S前锋"}]))
    assert len(rows) == 1


def test_last_name_null_quarantines(spark):
    rows, q = run(bars(spark, [{}, {"name": None}]))
    assert rows == [] and q == {"s1": "last_name_null"}


def test_no_name_column_skips_name_rules(spark):
    df = bars(spark, [{}, {"amount": 0.0}], drop=("name",))
    rows, q = run(df)
    assert len(rows) == 2 and q == {}


def test_missing_required_column(spark):
    rows, q = run(bars(spark, [{}, {}], drop=("volume",)))
    assert rows == [] and q == {"s1": "missing_column"}


def test_duplicate_key_and_long_code(spark):
    dup = bars(spark, [{}, {"trade_date": dt.date(2021, 1, 4), "close": 10.1}], src="dup")
    long = bars(spark, [{"code": "x" * 16}], src="long")
    rows, q = run(dup.unionByName(long))
    assert rows == [] and q == {"dup": "duplicate_key", "long": "too_long"}


def test_overflow(spark):
    rows, q = run(bars(spark, [{"close": 1e9, "high": 1e9, "pre_close": 1e9}]))
    assert q == {"s1": "numeric_overflow"}


def test_bad_cells_become_null(spark):
    df = spark.createDataFrame(
        [("s", "2020-13-01", "c", "n", "1,000", "abc", "1.0d", "inf", "NaN", "+3", " 1.5 ", "", "1e5"),
         ("s", "2020/01/02", "NA", "null", "1", "1", "1", "1", "1", "1", "1", "1", "1"),
         ("s", "20200103", "c", "n", "1", "1", "1", "1", "1", "1", "1", "1", "1")],
        "src string, trade_date string, code string, name string, open string, high string, low string, "
        "close string, pre_close string, volume string, amount string, circulation_market_value string, "
        "total_market_value string")
    from barsmith.operators.clean import standardize
    r = sorted(standardize(df).collect(), key=lambda x: str(x["trade_date"]))
    first = [x for x in r if x["trade_date"] is None][0]
    assert (first["open"], first["high"], first["low"], first["pre_close"]) == (None, None, None, None)
    assert first["close"] == float("inf") and first["volume"] == 3.0 and first["amount"] == 1.5
    assert first["circulation_market_value"] is None and first["total_market_value"] == 1e5
    dates = sorted(str(x["trade_date"]) for x in r if x["trade_date"] is not None)
    assert dates == ["2020-01-02", "2020-01-03"]
    second = [x for x in r if str(x["trade_date"]) == "2020-01-02"][0]
    assert second["code"] is None and second["name"] is None


def test_split_series_match_whole(spark):
    from barsmith.plans.fixtures import raw_bars
    from sf_paths import SF_SMALL
    rb = raw_bars(spark, SF_SMALL)
    a = clean_bars(rb).clean()
    b = clean_bars(rb, max_series_rows=10).clean()
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_copies_are_spread_and_still_exact(spark):
    from pyspark.sql import functions as F

    from barsmith.operators import clean as C
    from barsmith.operators.clean import standardize
    rows = [{}] + [{"close": 10.1, "pre_close": 10.0}] * 60 + [{"close": 10.2, "pre_close": 10.1}]
    df = bars(spark, rows)
    df = df.withColumn("trade_date", F.when(F.col("close") == 10.1, F.lit(dt.date(2021, 1, 5)))
                       .otherwise(F.col("trade_date")))
    a, qa = run(df)
    b, qb = run(df, max_series_rows=8)
    assert qa == qb == {"s1": "duplicate_key"} and a == b == []
    s = C.position(standardize(df), 8)
    segs = s.df.filter(F.col("close") == 10.1).select("_seg").distinct().count()
    assert s.segmented and segs > 1
    pos = sorted(r["pos"] for r in s.df.collect())
    assert pos == list(range(1, 63))


def test_lag_carries_over_empty_segments(spark):
    rows = [{"pre_close": None, "close": 10.0 + 0.01 * i} for i in range(40)]
    for i in range(10, 26):
        rows[i]["volume"] = None  # a run of invalid rows spanning whole segments
    df = bars(spark, rows)
    a, qa = run(df)
    b, qb = run(df, max_series_rows=6)
    assert qa == qb == {}
    assert [(r["trading_days"], r["pct_change"]) for r in a] == [(r["trading_days"], r["pct_change"]) for r in b]
    after_gap = [r for r in a if r["trading_days"] == 27][0]
    assert after_gap["pct_change"] == pytest.approx((10.0 + 0.26) / (10.0 + 0.09) - 1)


def test_mixed_hot_and_cold_series(spark):
    from barsmith.plans.fixtures import raw_bars
    from sf_paths import SF_SMALL
    rb = raw_bars(spark, SF_SMALL)
    sizes = sorted(r["n"] for r in rb.groupBy("src").agg(F.count("*").alias("n")).collect())
    threshold = sizes[len(sizes) // 2]  # about half the series count as hot
    res = clean_bars(rb, max_series_rows=threshold)
    assert res.segmented and res.split_marked is not None
    a, b = clean_bars(rb).clean(), res.clean()
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    qa = {r["src"]: r["reason"] for r in clean_bars(rb).quarantine().collect()}
    assert qa == {r["src"]: r["reason"] for r in res.quarantine().collect()}
