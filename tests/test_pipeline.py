"""Step composition (X1-X4) and the user-function surface."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith.plans.pipeline import Pipeline, PipelineError, per_series


def test_empty_pipeline(spark):
    p = Pipeline.create([])
    assert p.steps == []
    df = spark.range(3)
    assert p.run(df) is df
    assert Pipeline.create().steps == []


def test_steps_chain_and_handle_objects(spark):
    class Double:
        def handle(self, df):
            return df.withColumn("id", F.col("id") * 2)

    out = Pipeline.create([Double(), lambda d: d.filter("id > 2")]).run(spark.range(4))
    assert sorted(r["id"] for r in out.collect()) == [4, 6]


def test_error_names_the_step(spark):
    def broken(df):
        return df.select("missing_column")

    with pytest.raises(PipelineError, match="broken"):
        Pipeline.create([broken]).run(spark.range(1))


def test_per_series_pandas_step(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "src string, close double")

    def demean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(close=pdf.close - pdf.close.mean())

    out = Pipeline.create([per_series(demean, "src string, close double", max_rows=10)]).run(df)
    assert sorted(r["close"] for r in out.collect()) == [-1.0, 0.0, 1.0]
    with pytest.raises(PipelineError):
        Pipeline.create([per_series(demean, "src string, close double", max_rows=1)]).run(df).collect()


def test_standard_chain_adapt_clean_save(spark, tmp_path):
    import datetime as dt

    from barsmith import contracts as K
    from barsmith.plans.steps import AdaptStep, CleanStep, SaveStep
    from barsmith.sources.tables import ParquetTable

    back = {v: k for k, v in K.HEADER_MAP.items()}
    rows = [("s1", dt.date(2021, 1, 4 + i), "sh600000", "Co", 10.0, 11.0, 9.0, 10.0 + i * 0.1, 10.0, 100.0,
             1000.0, 1e6, 2e6) for i in range(3)]
    raw = spark.createDataFrame(rows, K.BAR_SCHEMA).withColumnsRenamed(back)
    table = ParquetTable.daily(spark, str(tmp_path))
    clean = CleanStep()
    out = Pipeline.create([AdaptStep(), clean, SaveStep(table)]).run(raw)
    assert out.count() == 3 and clean.last_result is not None
    stored = table.read()
    assert stored.count() == 3 and {r["trading_days"] for r in stored.collect()} == {1, 2, 3}


def test_minute_table_three_keys(spark, tmp_path):
    import datetime as dt

    from barsmith.sources.tables import ParquetTable
    tbl = ParquetTable.minute(spark, str(tmp_path))
    d = dt.date(2024, 1, 2)
    tbl.upsert(spark.createDataFrame([("u1", d, 600, 1.0), ("u1", d, 660, 2.0)],
                                     "code string, trade_date date, time int, close double"))
    tbl.upsert(spark.createDataFrame([("u1", d, 660, 5.0), ("u1", d, 720, 6.0)],
                                     "code string, trade_date date, time int, close double"))
    got = {r["time"]: float(r["close"]) for r in tbl.read().collect()}
    assert got == {600: 1.0, 660: 5.0, 720: 6.0}
