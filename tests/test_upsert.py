"""Keyed upsert, append and the Parquet table store."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barsmith import contracts as K
from barsmith.operators.upsert import latest_per_key, merge, validate
from barsmith.sources.tables import ParquetTable



def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


def frame(spark, rows, cols="code string, trade_date date, close double, name string"):
    return spark.createDataFrame(rows, cols)


D1, D2, D3 = dt.date(2020, 1, 2), dt.date(2020, 1, 3), dt.date(2021, 1, 4)


def test_merge_updates_present_columns_only(spark):
    t = frame(spark, [("a", D1, 1.0, "A"), ("a", D2, 2.0, "A")])
    s = frame(spark, [("a", D2, 20.0), ("b", D1, 5.0)], "code string, trade_date date, close double")
    out = {(r["code"], r["trade_date"]): r for r in merge(t, s, ["code", "trade_date"], audit=False).collect()}
    assert out[("a", D2)]["close"] == 20.0 and out[("a", D2)]["name"] == "A"
    assert out[("a", D1)]["close"] == 1.0
    assert out[("b", D1)]["close"] == 5.0 and out[("b", D1)]["name"] is None


def test_keys_only_inserts_new_keys(spark):
    t = frame(spark, [("a", D1, 1.0, "A")])
    s = frame(spark, [("a", D1), ("c", D1)], "code string, trade_date date")
    out = {r["code"]: r for r in merge(t, s, ["code", "trade_date"], audit=False).collect()}
    assert out["a"]["close"] == 1.0 and out["c"]["close"] is None


def test_validation_errors(spark):
    with pytest.raises(ValueError):
        validate(["code"], "t", [])
    with pytest.raises(ValueError):
        validate(["code"], "t", ["trade_date"])
    with pytest.raises(ValueError):
        validate(["code"], "bad name;", ["code"])
    with pytest.raises(ValueError):
        validate(["code", "x-y"], "t", ["code"])


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", D1, 1.0, "f1", 1), ("a", D1, 2.0, "f2", 2), ("a", D1, 3.0, "f0", 2)],
                               "code string, trade_date date, close double, src string, t int")
    row = latest_per_key(df, ["code", "trade_date"], [F.col("t"), F.col("src")]).collect()
    assert len(row) == 1 and row[0]["close"] == 2.0


def test_table_upsert_partitions_and_audit(spark, tmp_path):
    tbl = ParquetTable.daily(spark, str(tmp_path))
    first = frame(spark, [("a", D1, 1.0, "A"), ("a", D3, 3.0, "A")])
    assert tbl.upsert(first, now=_ts("2024-01-01 00:00:00"))
    second = frame(spark, [("a", D1, 10.0), ("b", D1, 7.0)], "code string, trade_date date, close double")
    assert tbl.upsert(second, now=_ts("2024-02-01 00:00:00"))
    rows = {(r["code"], r["trade_date"]): r for r in tbl.read().collect()}
    assert len(rows) == 3
    a1 = rows[("a", D1)]
    assert float(a1["close"]) == 10.0 and a1["name"] == "A"
    assert a1["created_at"] == dt.datetime(2024, 1, 1) and a1["updated_at"] == dt.datetime(2024, 2, 1)
    assert rows[("a", D3)]["updated_at"] == dt.datetime(2024, 1, 1)
    assert rows[("b", D1)]["created_at"] == dt.datetime(2024, 2, 1)
    assert [f.name for f in tbl.read().schema.fields] == [f.name for f in K.DAILY_SCHEMA.fields]
    # the 2021 partition was not part of the second upsert and kept its files
    assert tbl.upsert(frame(spark, [], "code string, trade_date date, close double")) is False


def test_table_append_checks_columns(spark, tmp_path):
    tbl = ParquetTable.daily(spark, str(tmp_path))
    tbl.append(frame(spark, [("a", D1, 1.0, "A")]))
    assert tbl.read().count() == 1
    with pytest.raises(ValueError):
        tbl.append(spark.createDataFrame([("a", D1, 1)], "code string, trade_date date, bogus int"))


def test_table_upsert_refuses_duplicate_keys(spark, tmp_path):
    tbl = ParquetTable.daily(spark, str(tmp_path))
    with pytest.raises(ValueError, match="duplicate"):
        tbl.upsert(frame(spark, [("a", D1, 1.0, "A"), ("a", D1, 2.0, "B")]))


def test_a_write_that_dies_midway_loses_nothing(spark, tmp_path, monkeypatch):
    tbl = ParquetTable.daily(spark, str(tmp_path))
    tbl.upsert(spark.createDataFrame([("a", dt.date(2020, 1, 2), 1.0), ("b", dt.date(2021, 1, 2), 2.0)], "code string, trade_date date, close double"))
    source = spark.createDataFrame([("a", dt.date(2020, 1, 2), 9.0), ("c", dt.date(2020, 1, 3), 3.0)], "code string, trade_date date, close double")

    def die(self, state):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(ParquetTable, "_commit", die)  # rows are written, the commit never happens
        with pytest.raises(OSError, match="driver is gone"):
            tbl.upsert(source)
    assert {r["code"]: float(r["close"]) for r in tbl.read().collect()} == {"a": 1.0, "b": 2.0}
    before = tbl.read()
    tbl.upsert(source)
    want = {"a": 9.0, "b": 2.0, "c": 3.0}
    assert {r["code"]: float(r["close"]) for r in tbl.read().collect()} == want
    assert before.count() == 2  # a frame read before the commit stays readable
    for _ in range(3):
        tbl.upsert(source)
    assert {r["code"]: float(r["close"]) for r in tbl.read().collect()} == want
    assert len([f for f in os.listdir(tbl.path) if f.startswith("_state-")]) == 2


def test_absent_columns_keep_stored_values(spark, tmp_path):
    from barsmith.operators.clean import PRESENT

    tbl = ParquetTable.daily(spark, str(tmp_path))
    day = dt.date(2020, 1, 2)
    tbl.upsert(spark.createDataFrame([("a", day, "x", 10.0, 1050.0)], "code string, trade_date date, name string, close double, amount double"))
    rows = [("a", day, None, 11.0, None, False, False, 1, "f1"), ("a", day, "y", 12.0, None, True, False, 0, "f0"), ("n", day, None, 5.0, 7.0, False, True, 1, "f1")]
    df = spark.createDataFrame(rows, "code string, trade_date date, name string, close double, amount double, present_name boolean, present_amount boolean, t int, src string")
    one = latest_per_key(df, ("code", "trade_date"), [F.col("t"), F.col("src")], present=PRESENT)
    tbl.upsert(one.drop("t", "src"), present=PRESENT)
    got = {r["code"]: (r["name"], float(r["close"]), r["amount"] and float(r["amount"])) for r in tbl.read().collect()}
    assert got == {"a": ("y", 11.0, 1050.0), "n": (None, 5.0, 7.0)}


def test_layers_read_as_the_upserts_they_stand_for(spark, tmp_path, monkeypatch):
    """Layered upserts give the table that rewriting ones give, at every level of merged layers and after a fold."""
    from barsmith.operators.clean import PRESENT
    from barsmith.sources import tables
    monkeypatch.setattr(tables, "LAYERS", 2)
    cols = [f for f in tables.K.DAILY_SCHEMA.fields if f.name not in tables.K.AUDIT_COLUMNS]
    flags = {c: f for c, f in PRESENT.items() if c in {x.name for x in cols}}

    def batch(n, keys, lacks=()):
        given = {"open": float(n), "close": n + 0.005, "amount": 100.0 * n, "pre_close": None if n == 3 else n + 0.5, "name": f"n{n}", "trading_days": n}
        rows = [tuple({"code": code, "trade_date": date, **given}.get(f.name) if f.name not in lacks else None for f in cols) + tuple(c not in lacks for c in flags)
                for code, date in keys]
        kinds = {"code": "string", "name": "string", "trade_date": "date", "trading_days": "int"}
        schema = ", ".join([f"{f.name} {kinds.get(f.name, 'double')}" for f in cols] + [f"{f} boolean" for f in flags.values()])
        return spark.createDataFrame(rows, schema)

    may = dt.date(2021, 5, 3)
    batches = [
        batch(1, [("a", D1), ("b", D1)]),
        batch(2, [("a", D1), ("c", may)], ("amount", "pre_close", "avg_price")),
        batch(3, [("a", D1), ("b", may), (None, D1)]),
        batch(4, [("b", D1), (None, D1)], ("amount",)),
        batch(5, [("d", D1), ("c", may)], ("pre_close",)),
        batch(6, [("d", D1)], ("pre_close", "amount")),
    ]
    for first in (0, 2):  # without and with rows in the partitions
        plain, layered = (tables.ParquetTable.daily(spark, str(tmp_path / f"{kind}{first}")) for kind in ("plain", "layered"))
        for i, source in enumerate(batches):
            now = _ts(f"2024-0{i + 1}-01 00:00:00")
            plain.upsert(source, now=now, present=flags)
            if i < first:
                layered.upsert(source, now=now, present=flags)
            else:
                assert layered.upsert_layer(source, now=now, present=flags) == source.count()
            want = sorted(map(repr, plain.read().collect()))
            assert sorted(map(repr, layered.read().collect())) == want
        assert len(layered.state()["layers"]) == (2 if first == 0 else 1)  # 6 batches: levels 2 and 1; 4: level 2
        assert layered.upsert_layer(batches[0].limit(0), present=flags) == 0
        layered.fold()
        assert "layers" not in layered.state() and sorted(map(repr, layered.read().collect())) == want
        layered.fold()  # nothing to do
        layered.upsert_layer(batches[0], now=_ts("2024-09-01 00:00:00"), present=flags)
        plain.upsert(batches[0], now=_ts("2024-09-01 00:00:00"), present=flags)
        for t in (plain, layered):  # a rewriting upsert comes after the layers
            t.upsert(batches[4], now=_ts("2024-10-01 00:00:00"), present=flags)
        assert "layers" not in layered.state()
        assert sorted(map(repr, layered.read().collect())) == sorted(map(repr, plain.read().collect()))


def test_a_layer_needs_every_stored_column(spark, tmp_path):
    from barsmith.sources.tables import ParquetTable
    tbl = ParquetTable.daily(spark, str(tmp_path))
    with pytest.raises(ValueError):
        tbl.upsert_layer(frame(spark, [("a", D1, 1.0)], "code string, trade_date date, close double"))
    assert tbl.read().count() == 0


