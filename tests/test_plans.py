"""Plan shape guards: the scale properties the design relies on."""

import re

import __spark_entry__ as entry
from sf_paths import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_two_exchanges_and_pruned_scan(spark):
    plan = _plan(entry.queries()["clean_daily"](spark, SF_SMALL))
    exchanges = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)
    assert len(exchanges) == 2, plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1).split(",")
    assert len(cols) == 6


def test_upsert_reads_only_touched_partitions(spark, tmp_path):
    import datetime as dt

    from barsmith.sources.tables import ParquetTable
    tbl = ParquetTable.daily(spark, str(tmp_path))
    rows = [("a", dt.date(2019 + i, 1, 2), 1.0) for i in range(3)]
    tbl.upsert(spark.createDataFrame(rows, "code string, trade_date date, close double"))
    src = spark.createDataFrame([("a", dt.date(2021, 1, 2), 5.0)], "code string, trade_date date, close double")
    before = tbl.state()
    tbl.upsert(src)
    after = tbl.state()
    assert {p for p in after if after[p] != before.get(p)} == {"202101"}
    got = {r["trade_date"].year: float(r["close"]) for r in tbl.read().collect()}
    assert got == {2019: 1.0, 2020: 1.0, 2021: 5.0}
