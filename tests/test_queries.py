"""Every registered query against its DuckDB statement on sf0.001 (the correctness gate, small)."""

import decimal
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from barsmith.plans.catalog import QUERIES, SQL
from sf_paths import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# Whole-job queries write files and run several jobs; test_daily_job covers them faster.
SLOW = {"daily_job", "daily_job_rerun", "stream_ingest"}


def _norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if v == 0 or math.isinf(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        text = str(v.isoformat())
        return text[:10] if text.endswith("00:00:00") else text
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "pct_change" in df.columns


def test_every_query_has_oracle_or_is_declared_rows_only():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(QUERIES) == set(SQL) <= set(qs)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n not in SLOW))
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    gc, gr = _rows(got.astype(object).where(got.notna(), None))
    wc, wr = _rows(want.astype(object).where(want.notna(), None))
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
