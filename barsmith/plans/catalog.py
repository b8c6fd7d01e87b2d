"""The registered queries: one per operator group of the inventory.

Each query takes ``(spark, sf_dir)``, reads the test tables (or frames Spark
derives from them) and returns a DataFrame; ``SQL`` holds the matching DuckDB
statement where one exists.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts as K
from ..functions import rules
from ..operators import clean as C
from ..operators import factors as FX
from ..operators import manifest as M
from ..operators.adapt import drop_helper, keep_standard, rename_headers
from ..operators.clean import OUTPUT_COLUMNS, clean_bars, standardize
from ..operators.upsert import append_rows, latest_per_key, merge, to_contract
from ..session import checkpoint_dir
from ..sources.base import ParquetBarsSource
from ..streaming.ingest import start_ingest
from .daily import read_daily, run_daily
from ..sources.csv import list_sources, load_csv, scan
from ..sources.custom import ArrowParquetSource
from ..sources.tables import ParquetTable
from .pipeline import Pipeline, per_series
from .steps import AdaptStep, CleanStep, SaveStep
from . import oracle_sql as O
from .fixtures import (MANIFEST_NOW, MANIFEST_SQL, RAW_TEXT_EXPECTED_SQL, minute_bars, page_listing,
                       page_manifest, raw_bars, raw_bars_cn, raw_bars_text, write_quote_files)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("clean_daily", O.with_clean("SELECT * FROM clean_daily"))
def clean_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the whole cleaner over every series, quarantined sources removed."""
    return clean_bars(raw_bars(spark, sf_dir)).clean().select(*OUTPUT_COLUMNS)


@register("quarantine_reasons", O.with_clean(
    "SELECT src, min(reason) AS reason FROM _checked WHERE reason IS NOT NULL GROUP BY src"))
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources set aside by the cleaner, one row each with the first reason that applies."""
    return clean_bars(raw_bars(spark, sf_dir)).quarantine()


# raw_bars with series spoiled in every way the cleaner sets a source aside for.
_SPOILED = """
raw_bars_2 AS (
  SELECT src, trade_date, CASE WHEN k % 13 = 1 THEN code || 'xxxxxxxxxxxx' ELSE code END AS code,
         CASE WHEN k % 13 = 4 THEN NULL ELSE name END AS name, open, high, low, close, pre_close, volume,
         CASE WHEN k % 13 = 3 THEN 1e20::DOUBLE ELSE amount END AS amount, circulation_market_value, total_market_value
  FROM (SELECT *, CAST(substr(src, 2) AS BIGINT) AS k FROM raw_bars) JOIN (SELECT unnest([0, 1]) AS copy) ON copy = 0 OR k % 13 = 2
  WHERE k % 13 <> 5)"""
# The cleaning rules over the frame raw_bars_2, under names of their own.
SECOND_CTES = re.sub(r"\b(_f1|_f3|_a1|_p0|_d|_k4|_f5|_kept|_checked|clean_daily|raw_bars)\b", r"\1_2", O.CLEAN_CTES)


@register("quarantine_spoiled", O.with_raw(_SPOILED.strip() + "," + SECOND_CTES, """
SELECT src, min(reason) AS reason FROM _checked_2 WHERE reason IS NOT NULL GROUP BY src
UNION ALL
SELECT DISTINCT src, 'missing_column' FROM raw_bars WHERE CAST(substr(src, 2) AS BIGINT) % 13 = 5"""))
def quarantine_spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 + C14 + U3 + F6: every series is cleaned, and those spoiled on purpose are set aside with their reason.

    One series in thirteen has a code too long to store, one every key twice, one amounts beyond the stored
    decimal, one no name, and one comes from a source without a volume column.
    """
    k = F.substring(F.col(K.SRC), 2, 20).cast("long") % 13
    bars = raw_bars(spark, sf_dir).withColumns({
        "code": F.when(k == 1, F.concat("code", F.lit("xxxxxxxxxxxx"))).otherwise(F.col("code")),
        "name": F.when(k == 4, F.lit(None)).otherwise(F.col("name")),
        "amount": F.when(k == 3, F.lit(1e20)).otherwise(F.col("amount"))})
    std = standardize(bars.unionByName(bars.where(k == 2)))
    std = std.withColumn(K.presence_flag("volume"), F.col(K.presence_flag("volume")) & (k != 5))
    return clean_bars(std, standardized=True).quarantine()


# -- per-rule queries (each is one stage of the cleaner on raw_bars) ------------

def _std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize(raw_bars(spark, sf_dir))


def _derived(spark: SparkSession, sf_dir: str):
    return C.derive(C.valid(C.position(_std(spark, sf_dir))))


@register("adapt_columns", O.with_raw("", (
    "SELECT src, trade_date, code, name, open, high, low, close, pre_close, volume, amount, "
    "circulation_market_value FROM raw_bars")))
def adapt_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2: Chinese headers renamed; only standard columns kept, absent ones left out."""
    return keep_standard(rename_headers(raw_bars_cn(spark, sf_dir)))


@register("coerce_types", O.with_raw(RAW_TEXT_EXPECTED_SQL.split(")\nSELECT", 1)[0] + ")",
                                     "SELECT" + RAW_TEXT_EXPECTED_SQL.split(")\nSELECT", 1)[1]))
def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells to dates and doubles; bad cells, NA tokens and NaN become NULL."""
    return standardize(raw_bars_text(spark, sf_dir)).select(K.SRC, *K.STANDARD_COLUMNS)


@register("series_position", O.with_clean("SELECT src, trade_date, pos FROM _f1"))
def series_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + W1 + O1: rows with date and code, numbered per series by date."""
    return C.position(_std(spark, sf_dir)).df.select(K.SRC, "trade_date", "pos")


@register("valid_rows", O.with_clean(
    "SELECT src, trade_date, code, open, high, low, close, volume, pos FROM _f3"))
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + F3 after W1: complete, positive prices and non-negative volume keep their position."""
    return C.valid(C.position(_std(spark, sf_dir))).df.select(
        K.SRC, "trade_date", "code", "open", "high", "low", "close", "volume", "pos")


@register("pct_change_preclose", O.with_clean(
    "SELECT src, trade_date, pct_change, trading_days FROM _d WHERE has_pc"))
def pct_change_preclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + C4 + W3: change against pre_close in series that carry one; row 1 repaired from its open."""
    return _derived(spark, sf_dir).df.filter("pct_from_pre_close").select(
        K.SRC, "trade_date", "pct_change", "trading_days")


@register("pct_change_lag", O.with_clean(
    "SELECT src, trade_date, pct_change, trading_days FROM _d WHERE NOT has_pc"))
def pct_change_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + W2 + W3: change against the previous surviving close where no pre_close exists."""
    return _derived(spark, sf_dir).df.filter("NOT pct_from_pre_close").select(
        K.SRC, "trade_date", "pct_change", "trading_days")


@register("turnover_rate", O.with_clean("SELECT src, trade_date, turnover_rate FROM _d"))
def turnover_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 + P4: amount over circulating market value, 0 when that is not positive."""
    return _derived(spark, sf_dir).df.select(K.SRC, "trade_date", "turnover_rate")


@register("avg_price", O.with_clean("SELECT src, trade_date, avg_price FROM _d"))
def avg_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 + P4: amount over volume, the close when volume is 0."""
    return _derived(spark, sf_dir).df.select(K.SRC, "trade_date", "avg_price")


@register("limit_threshold", O.with_raw("", (
    f"SELECT src, trade_date, code, name, {O.THRESHOLD_SQL} AS price_limit_threshold "
    "FROM raw_bars WHERE trade_date IS NOT NULL AND code IS NOT NULL")))
def limit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 + C8 + C10 + C11: each row's price limit by board, ST name and the sz30 switch date."""
    std = _std(spark, sf_dir).filter(F.col("trade_date").isNotNull() & F.col("code").isNotNull())
    return std.select(K.SRC, "trade_date", "code", "name", rules.limit_threshold(
        F.col("code"), F.col("name"), F.col("trade_date"), F.col(K.presence_flag("name")))
        .alias("price_limit_threshold"))


@register("limit_filter", O.with_clean("SELECT src, trade_date, pct_change, trading_days FROM _k4"))
def limit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 + F4 + W5 + P3: rows within limit + 0.02, row 1 always kept; helper column dropped."""
    return drop_helper(_derived(spark, sf_dir).df.filter("keep4")).select(
        K.SRC, "trade_date", "pct_change", "trading_days")


@register("delist_truncate", O.with_clean("SELECT src, trade_date, amount FROM _kept"))
def delist_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 + F5 + A2 + W6-W8: delisted series cut after the last non-zero amount."""
    return C.delist(_derived(spark, sf_dir)).df.filter("keep").select(K.SRC, "trade_date", "amount")


# -- upsert, append, contracts (U1-U6, S10-S14, C13, J4) ------------------------

DAILY_COLS = K.DAILY_KEYS + O.DAILY_VALUE_COLUMNS
MINUTE_COLS = K.MINUTE_KEYS + ("open", "high", "low", "close", "volume", "amount")
_SPLIT, _FROM = "2021-01-01", "2020-07-01"

PAIR_CTES = O.CLEAN_CTES + f""",
_tgt AS (SELECT {', '.join(DAILY_COLS)} FROM clean_daily WHERE trade_date < DATE '{_SPLIT}'),
_srcf AS (SELECT {', '.join(c if c != 'close' else 'close + 1.0 AS close' for c in DAILY_COLS)}
          FROM clean_daily WHERE trade_date >= DATE '{_FROM}')"""


def _daily_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned bars, computed once and checkpointed: the upsert pair takes two slices of it."""
    checkpoint_dir(spark)
    return clean_bars(raw_bars(spark, sf_dir)).clean().select(*DAILY_COLS).checkpoint()


def _pair(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Upsert pair: stored rows before 2021, incoming rows from mid-2020 with the close raised by 1."""
    daily = daily if daily is not None else _daily_once(spark, sf_dir)
    target = daily.filter(F.col("trade_date") < F.lit(_SPLIT).cast("date"))
    source = daily.filter(F.col("trade_date") >= F.lit(_FROM).cast("date")).withColumn(
        "close", F.col("close") + 1.0)
    return target, source


@register("upsert_daily", O.with_raw(PAIR_CTES, O.merge_sql("_tgt", "_srcf", K.DAILY_KEYS, DAILY_COLS, DAILY_COLS)))
def upsert_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + J4: overlapping keys take the incoming values, new keys are inserted."""
    target, source = _pair(spark, sf_dir)
    return merge(target, source, K.DAILY_KEYS, audit=False)


@register("upsert_subset", O.with_raw(PAIR_CTES, O.merge_sql(
    "_tgt", "_srcf", K.DAILY_KEYS, DAILY_COLS, tuple(c for c in DAILY_COLS if c != "name"))))
def upsert_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 with an absent column: incoming rows without ``name`` keep the stored name."""
    target, source = _pair(spark, sf_dir)
    return merge(target, source.drop("name"), K.DAILY_KEYS, audit=False)


@register("upsert_keys_only", O.with_raw(PAIR_CTES, O.merge_sql(
    "_tgt", "_srcf", K.DAILY_KEYS, DAILY_COLS, K.DAILY_KEYS)))
def upsert_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-only source inserts its new keys and changes nothing else."""
    target, source = _pair(spark, sf_dir)
    return merge(target, source.select(*K.DAILY_KEYS), K.DAILY_KEYS, audit=False)


@register("latest_wins", O.with_raw(O.CLEAN_CTES + f""",
_both AS (
  SELECT {', '.join(DAILY_COLS)}, 'a' AS source_file, 2 AS file_time FROM clean_daily
  UNION ALL
  SELECT {', '.join(c if c != 'close' else 'close + 2.0 AS close' for c in DAILY_COLS)}, 'b',
         CASE trading_days % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END
  FROM clean_daily)""", f"""
SELECT {', '.join(DAILY_COLS)}, source_file, file_time FROM (
  SELECT *, row_number() OVER (PARTITION BY code, trade_date ORDER BY file_time DESC, source_file DESC) AS rn
  FROM _both) WHERE rn = 1"""))
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: every key from two files resolves to the newer file (of equal times, the greater path)."""
    daily = _daily_once(spark, sf_dir)
    a = daily.withColumns({"source_file": F.lit("a"), "file_time": F.lit(2)})
    b = daily.withColumns({"close": F.col("close") + 2.0, "source_file": F.lit("b"),
                           "file_time": F.when(F.col("trading_days") % 3 == 0, 1).when(F.col("trading_days") % 3 == 1, 2).otherwise(3)})
    return latest_per_key(a.unionByName(b), K.DAILY_KEYS, [F.col("file_time"), F.col("source_file")])


_STAMP, _EARLIER = "2024-06-01 12:00:00", "2024-05-01 08:00:00"


@register("upsert_audit", O.with_raw(PAIR_CTES, f"""
SELECT coalesce(t.code, s.code) AS code, coalesce(t.trade_date, s.trade_date) AS trade_date,
       CASE WHEN t.code IS NULL THEN TIMESTAMP '{_STAMP}' ELSE TIMESTAMP '{_EARLIER}' END AS created_at,
       CASE WHEN s.code IS NULL THEN TIMESTAMP '{_EARLIER}' ELSE TIMESTAMP '{_STAMP}' END AS updated_at
FROM _tgt t FULL OUTER JOIN _srcf s ON t.code = s.code AND t.trade_date = s.trade_date"""))
def upsert_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit clocks of inserted, updated and untouched rows, under a fixed clock."""
    target, source = _pair(spark, sf_dir)
    early = F.lit(_EARLIER).cast("timestamp_ntz")
    stamped = target.withColumns({"created_at": early, "updated_at": early})
    merged = merge(stamped, source, K.DAILY_KEYS, now=F.lit(_STAMP).cast("timestamp_ntz"))
    return merged.select("code", "trade_date", "created_at", "updated_at")


@register("append_checked", O.with_raw(PAIR_CTES, f"""
SELECT {', '.join(DAILY_COLS)} FROM _tgt
UNION ALL
SELECT {', '.join(c if c != 'total_market_value' else 'NULL AS total_market_value' for c in DAILY_COLS)}
FROM clean_daily WHERE trade_date >= DATE '{_SPLIT}'"""))
def append_checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + U5: new rows appended after the name checks; a column they lack is NULL."""
    daily = _daily_once(spark, sf_dir)
    target, _ = _pair(spark, sf_dir, daily)
    new = daily.filter(F.col("trade_date") >= F.lit(_SPLIT).cast("date")).drop("total_market_value")
    return append_rows(target, new, "stock_daily")


_CONTRACT_FIELDS = [f for f in K.DAILY_SCHEMA.fields if f.name not in K.AUDIT_COLUMNS]


def _decimal_sql(f) -> str:
    if isinstance(f.dataType, T.DecimalType):
        return (f"CAST(CAST({f.name} AS VARCHAR) AS DECIMAL({f.dataType.precision},{f.dataType.scale})) "
                f"AS {f.name}")
    return f.name


@register("daily_contract", O.with_clean(
    f"SELECT {', '.join(_decimal_sql(f) for f in _CONTRACT_FIELDS)} FROM clean_daily"))
def daily_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 + S13 + C13: cleaned bars cast to the stored table's decimals (audit clocks left out)."""
    daily = clean_bars(raw_bars(spark, sf_dir)).clean()
    return to_contract(daily, T.StructType(_CONTRACT_FIELDS))


@register("minute_contract", O.with_ctes(O.MINUTE_BARS_SQL_REF + """,
_mt AS (SELECT * FROM minute_bars WHERE trade_date < DATE '2024-01-20'),
_ms AS (SELECT code, trade_date, time, open, high, low, close + 1.0 AS close, volume, amount
        FROM minute_bars WHERE trade_date >= DATE '2024-01-15')""",
    O.merge_sql("_mt", "_ms", K.MINUTE_KEYS, MINUTE_COLS, MINUTE_COLS)))
def minute_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 + U1 on three keys: minute bars (time as seconds of day) upserted by (code, date, time)."""
    bars = minute_bars(spark, sf_dir).select(*MINUTE_COLS)
    target = bars.filter(F.col("trade_date") < F.lit("2024-01-20").cast("date"))
    source = bars.filter(F.col("trade_date") >= F.lit("2024-01-15").cast("date")).withColumn(
        "close", F.col("close") + 1.0)
    return merge(target, source, K.MINUTE_KEYS, audit=False)


# -- manifest: incremental ingestion (M1-M11, J1-J3, A3, A4) --------------------

_NOW = f"TIMESTAMP '{MANIFEST_NOW}'"
MANIFEST_CTES = MANIFEST_SQL + f""",
_reset AS (
  SELECT source_identifier, source_hash,
         CASE WHEN _stale THEN 'pending' ELSE status END AS status,
         CASE WHEN _stale THEN NULL ELSE processed_at END AS processed_at, reason, _stale AS was_reset
  FROM (SELECT *, coalesce(status = 'processing'
                           AND (processed_at IS NULL OR processed_at < {_NOW} - INTERVAL 60 MINUTE), false) AS _stale
        FROM _manifest)),
_dec AS (
  SELECT *, CASE WHEN reason = 'no_fingerprint' THEN 'drop' WHEN reason IN ('in_progress', 'done') THEN 'skip'
                 ELSE 'process' END AS action
  FROM (SELECT l.source_identifier, l.source_hash, m.status AS stored_status, m.source_hash AS stored_hash,
               CASE WHEN l.source_identifier IS NULL OR l.source_identifier = ''
                         OR l.source_hash IS NULL OR l.source_hash = '' THEN 'no_fingerprint'
                    WHEN m.status IS NULL THEN 'new'
                    WHEN m.status = 'processing' THEN 'in_progress'
                    WHEN m.source_hash <> l.source_hash THEN 'changed'
                    WHEN m.status IN ('failed', 'pending') THEN m.status
                    ELSE 'done' END AS reason
        FROM _listing l LEFT JOIN _reset m ON l.source_identifier = m.source_identifier)),
_reg AS (
  SELECT source_identifier, source_hash, status, processed_at, reason FROM _reset
  UNION ALL
  SELECT source_identifier, source_hash, 'pending', NULL, NULL FROM _dec WHERE reason = 'new'),
_claimed AS (
  SELECT d.source_identifier, d.source_hash, r.status AS prior_status, r.source_hash AS prior_hash,
         r.processed_at AS prior_processed_at
  FROM _dec d LEFT JOIN _reg r ON d.source_identifier = r.source_identifier
  WHERE d.action = 'process' AND d.source_hash IS NOT NULL AND d.source_hash <> ''
    AND (r.status IS NULL OR r.status <> 'processing')),
_claim AS (
  SELECT r.source_identifier, coalesce(c.source_hash, r.source_hash) AS source_hash,
         CASE WHEN c.source_identifier IS NOT NULL THEN 'processing' ELSE r.status END AS status,
         CASE WHEN c.source_identifier IS NOT NULL THEN NULL ELSE r.processed_at END AS processed_at, r.reason
  FROM _reg r LEFT JOIN _claimed c ON r.source_identifier = c.source_identifier
  UNION ALL
  SELECT source_identifier, source_hash, 'processing', NULL, NULL FROM _claimed WHERE prior_status IS NULL),
_out AS (
  SELECT c.source_identifier,
         CASE WHEN l.page_id % 5 = 0 THEN c.prior_hash ELSE c.source_hash END AS source_hash,
         CASE WHEN l.page_id % 5 = 0 THEN c.prior_status WHEN l.page_id % 3 = 0 THEN 'failed'
              ELSE 'completed' END AS status,
         CASE WHEN l.page_id % 5 = 0 THEN c.prior_processed_at ELSE {_NOW} END AS processed_at,
         CASE WHEN l.page_id % 5 = 0 THEN 'not_loaded' WHEN l.page_id % 3 = 0 THEN 'first_row_dropped' END AS reason
  FROM _claimed c JOIN _listing l ON c.source_identifier = l.source_identifier),
_fin AS (
  SELECT m.source_identifier,
         CASE WHEN o.source_identifier IS NOT NULL THEN o.source_hash ELSE m.source_hash END AS source_hash,
         CASE WHEN o.source_identifier IS NOT NULL THEN o.status ELSE m.status END AS status,
         CASE WHEN o.source_identifier IS NOT NULL THEN o.processed_at ELSE m.processed_at END AS processed_at,
         CASE WHEN o.source_identifier IS NOT NULL THEN o.reason ELSE m.reason END AS reason
  FROM _claim m LEFT JOIN _out o ON m.source_identifier = o.source_identifier)"""


def _now():
    return F.lit(MANIFEST_NOW).cast("timestamp_ntz")


def _run_steps(spark: SparkSession, sf_dir: str, force: bool = False):
    listing = page_listing(spark, sf_dir)
    reset = M.reset_stale(page_manifest(spark, sf_dir), _now())
    decisions = M.decide(listing, reset, force=force)
    registered = reset if force else M.register_new(reset, decisions)
    claimed_manifest, claimed = M.claim(registered, decisions)
    return listing, reset, decisions, registered, claimed_manifest, claimed


def _run_outcome(spark: SparkSession, sf_dir: str):
    listing, _, _, _, claimed_manifest, claimed = _run_steps(spark, sf_dir)
    # Stand-in results of the load and clean steps: every fifth page is an empty
    # file, every third is quarantined by the cleaner.
    loaded = listing.filter(F.col("page_id") % 5 != 0)
    quarantine = listing.filter(F.col("page_id") % 3 == 0).select(
        M.ID, F.lit("first_row_dropped").alias("reason"))
    return claimed_manifest, M.outcome(claimed, loaded, quarantine, _now())


@register("reset_stale", O.with_ctes(MANIFEST_CTES, "SELECT * FROM _reset"))
def reset_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 + A4: unfinished or timed-out claims go back to pending (``was_reset`` counts them)."""
    return M.reset_stale(page_manifest(spark, sf_dir), _now())


@register("work_filter", O.with_ctes(
    MANIFEST_CTES, "SELECT source_identifier, source_hash, action, reason FROM _dec"))
def work_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M10 + M11 + J1: listing joined with the manifest; one action and reason per source."""
    return _run_steps(spark, sf_dir)[2].select(M.ID, M.HASH, "action", "reason")


@register("work_filter_force", O.with_ctes(
    MANIFEST_CTES, "SELECT source_identifier, source_hash, 'process' AS action, 'force' AS reason FROM _listing"))
def work_filter_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: with force every listed source is chosen, fingerprint or not."""
    return _run_steps(spark, sf_dir, force=True)[2].select(M.ID, M.HASH, "action", "reason")


@register("work_filter_single", O.with_ctes(MANIFEST_CTES, """
SELECT source_identifier, source_hash,
       CASE WHEN reason = 'done' AND page_id % 16 = 1 THEN 'process' ELSE action END AS action,
       CASE WHEN reason = 'done' AND page_id % 16 = 1 THEN 'archived' ELSE reason END AS reason
FROM _dec JOIN (SELECT url, page_id FROM pages) ON url = source_identifier"""))
def work_filter_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the single-source rule, where a status of no known meaning with an equal fingerprint is processed."""
    listing, manifest = page_listing(spark, sf_dir), page_manifest(spark, sf_dir)
    odd = listing.where(F.col("page_id") % 16 == 1).select(F.col(M.ID), F.lit("archived").alias("_odd"))
    manifest = manifest.join(odd, M.ID, "left").withColumn("status", F.coalesce("_odd", "status")).drop("_odd")
    reset = M.reset_stale(manifest, _now()).drop("was_reset")
    return M.decide(listing.drop("page_id"), reset, unknown_status_processes=True).select(M.ID, M.HASH, "action", "reason")


@register("work_summary", O.with_ctes(MANIFEST_CTES, "SELECT action, count(*) AS n FROM _dec GROUP BY action"))
def work_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: number of listed sources per action."""
    return M.summary(_run_steps(spark, sf_dir)[2])


@register("register_new", O.with_ctes(MANIFEST_CTES, "SELECT * FROM _reg"))
def register_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 + J3: sources seen for the first time are registered as pending; others untouched."""
    return _run_steps(spark, sf_dir)[3]


@register("claim", O.with_ctes(MANIFEST_CTES, "SELECT * FROM _claim"))
def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: chosen sources are claimed (processing + new fingerprint) unless already processing."""
    return _run_steps(spark, sf_dir)[4]


@register("run_outcome", O.with_ctes(MANIFEST_CTES, "SELECT * FROM _out"))
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + S7: completed, failed with reason, or restored when the file held no rows."""
    return _run_outcome(spark, sf_dir)[1]


@register("finish", O.with_ctes(MANIFEST_CTES, "SELECT * FROM _fin"))
def finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the manifest after the run's outcomes are written (finish time = the run's clock)."""
    claimed_manifest, outcomes = _run_outcome(spark, sf_dir)
    return M.finish(claimed_manifest, outcomes, _now())


_TRANSITION_SQL = """(
     ({f} IS NULL AND {t} IN ('pending', 'processing'))
  OR ({f} = 'pending' AND {t} IN ('processing', 'failed'))
  OR ({f} = 'processing' AND {t} IN ('completed', 'failed'))
  OR ({f} = 'failed' AND {t} IN ('processing'))
  OR ({f} = 'completed' AND {t} IN ('processing')))"""


def _step_sql(step: str, before: str, after: str) -> str:
    allowed = _TRANSITION_SQL.format(f="b.status", t="a.status")
    return (f"SELECT '{step}' AS step, a.source_identifier, b.status AS from_status, a.status AS to_status, "
            f"coalesce({allowed}, false) AS allowed FROM {after} a LEFT JOIN {before} b "
            f"ON a.source_identifier = b.source_identifier WHERE a.status IS DISTINCT FROM b.status")


@register("transition_check", O.with_ctes(
    MANIFEST_CTES, _step_sql("claim", "_reg", "_claim") + " UNION ALL " + _step_sql("finish", "_claim", "_fin")))
def transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: each status change of the claim and finish steps, checked against the allowed moves.

    Restoring an empty source to its status before the claim is reported as not
    allowed: the reference never commits such a claim, so its table has no move back.
    """
    _, _, _, registered, claimed_manifest, _ = _run_steps(spark, sf_dir)
    _, outcomes = _run_outcome(spark, sf_dir)
    finished = M.finish(claimed_manifest, outcomes, _now())
    return (M.transitions(registered, claimed_manifest).withColumn("step", F.lit("claim"))
            .unionByName(M.transitions(claimed_manifest, finished).withColumn("step", F.lit("finish"))))


# -- files on disk: listing, GBK scan, whole job (S1-S8, X5) --------------------

def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/queries/{name}-{uuid.uuid4().hex}"


@register("csv_roundtrip", O.with_clean(
    "SELECT " + ", ".join(c for c in OUTPUT_COLUMNS if c != K.SRC) + " FROM clean_daily"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S2 + S3 + S8 + cleaner: bars written as GBK quote files, listed, scanned and cleaned.

    Files carry a banner line and half of them the columns in reverse order; the
    result must equal ``clean_daily`` (without the source column, which is now a path).
    """
    folder = _scratch(spark, "quotes")
    write_quote_files(raw_bars(spark, sf_dir), folder)
    listing = list_sources(spark, folder, recursive=True)
    paths = [r[0] for r in listing.select("source_identifier").collect()]
    found = scan(spark, paths)
    counts = listing.select(F.col("source_identifier").alias(K.SRC),
                            (F.col("file_size") / 32).cast("long").alias("_n"))
    res = clean_bars(standardize(found.rows), standardized=True, counts=counts)
    return res.clean().drop(K.SRC)


@register("csv_listing", """
SELECT 'f' || CAST(l_suppkey AS VARCHAR) AS series, true AS fingerprint_ok, 'pending' AS status,
       CAST(count(DISTINCT CAST(l_shipdate AS DATE)) AS BIGINT) AS bars
FROM lineitem GROUP BY l_suppkey""")
def csv_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S8 + S15: written quote files listed as manifest-ready rows, one per series.

    The fingerprint holds the write time, so the check is on its form
    (``size:mtime_ns`` with the size equal to the file's). ``bars`` counts the data lines
    that the scan finds in each listed file.
    """
    folder = _scratch(spark, "listing")
    write_quote_files(raw_bars(spark, sf_dir), folder)
    listed = list_sources(spark, folder, recursive=True)
    size, ns = F.split("source_hash", ":")[0], F.split("source_hash", ":")[1]
    paths = [r[0] for r in listed.select("source_identifier").collect()]
    bars = scan(spark, paths, listing=listed).rows.groupBy(K.SRC).agg(F.count(F.lit(1)).alias("bars"))
    return listed.join(bars, F.col("source_identifier") == F.col(K.SRC)).select(
        F.regexp_extract("source_identifier", r"series=([^/]+)/", 1).alias("series"), "bars",
        (F.col("source_hash").rlike(r"^[0-9]+:[0-9]+$") & (size == F.col("file_size").cast("string"))
         & (ns.cast("long") > 0)).alias("fingerprint_ok"),
        F.lit(K.PENDING).alias("status"))


# -- sources: union, subset, custom connector (S4, S5, S9, O2, J2) --------------

@register("union_sources", O.with_raw("", """
SELECT src, trade_date, code, name, open, high, low, close, NULL::DOUBLE AS pre_close, volume, amount,
       circulation_market_value, total_market_value
FROM raw_bars WHERE CAST(substr(src, 2) AS BIGINT) % 2 = 0
UNION ALL
SELECT src, trade_date, code, name, open, high, low, close, pre_close, volume, NULL::DOUBLE AS amount,
       circulation_market_value, total_market_value
FROM raw_bars WHERE CAST(substr(src, 2) AS BIGINT) % 2 = 1"""))
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + O2: frames with different column sets united by name; absent columns are NULL."""
    bars = raw_bars(spark, sf_dir)
    k = F.substring(F.col(K.SRC), 2, 20).cast("long")
    even = bars.filter(k % 2 == 0).drop("pre_close")
    odd = bars.filter(k % 2 == 1).drop("amount")
    return even.unionByName(odd, allowMissingColumns=True).select(K.SRC, *K.STANDARD_COLUMNS)


@register("source_subset", O.with_ctes(MANIFEST_SQL, """
SELECT m.* FROM _manifest m
WHERE m.source_identifier IN (SELECT source_identifier FROM _listing WHERE source_hash IS NOT NULL)"""))
def source_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + J2: the manifest restricted to the listed sources that have a fingerprint (semi join)."""
    listed = page_listing(spark, sf_dir).filter(F.col("source_hash").isNotNull())
    return page_manifest(spark, sf_dir).join(listed.select("source_identifier"), "source_identifier", "left_semi")


@register("custom_source", O.with_raw("", """
SELECT src, count(*) AS bars, count(pre_close) AS with_pre_close, max(trade_date) AS last_date
FROM raw_bars GROUP BY src"""))
def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars stored as Parquet, listed and read through the source contract, then summarised."""
    folder = _scratch(spark, "parquet_bars")
    raw_bars(spark, sf_dir).write.mode("overwrite").parquet(folder)
    src = ParquetBarsSource(folder)
    bars = C.coerce_types(src.read(spark, src.listing(spark)))
    return bars.groupBy(K.SRC).agg(F.count(F.lit(1)).alias("bars"), F.count("pre_close").alias("with_pre_close"),
                                   F.max("trade_date").alias("last_date"))


@register("python_data_source", O.with_ctes("", """
SELECT l_suppkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey"""))
def python_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` read by the Python data source (pyarrow in the tasks), then aggregated by Spark."""
    spark.dataSource.register(ArrowParquetSource)
    li = (spark.read.format("bars_parquet").option("path", f"{sf_dir}/lineitem.parquet")
          .option("columns", "l_suppkey,l_quantity").load())
    return li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


# -- the whole job, batch and stream (X1-X5, S11, R1, R2) -----------------------

_TABLE_SQL = O.with_clean(
    f"SELECT {', '.join(_decimal_sql(f) for f in _CONTRACT_FIELDS)} FROM clean_daily")


def _stored(spark: SparkSession, warehouse: str) -> DataFrame:
    return read_daily(spark, warehouse).select(*[f.name for f in _CONTRACT_FIELDS])


@register("daily_job", _TABLE_SQL)
def daily_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 + S11 + S12: quote files → manifest → clean → upsert; the stored table (clocks left out)."""
    folder, warehouse = _scratch(spark, "job-files"), _scratch(spark, "job-warehouse")
    write_quote_files(raw_bars(spark, sf_dir), folder)
    run_daily(spark, folder, warehouse, recursive=True)
    return _stored(spark, warehouse)


@register("daily_job_rerun", _TABLE_SQL)
def daily_job_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M10 + X5: a second run over unchanged files skips the completed ones, retries only
    the failed ones (they fail again) and changes no stored row."""
    folder, warehouse = _scratch(spark, "rerun-files"), _scratch(spark, "rerun-warehouse")
    write_quote_files(raw_bars(spark, sf_dir), folder)
    run_daily(spark, folder, warehouse, recursive=True)
    report = run_daily(spark, folder, warehouse, recursive=True)
    if report.rows_upserted or report.decisions.get("process", 0) != report.outcomes.get("failed", 0):
        raise AssertionError(f"rerun did work: {report}")
    return _stored(spark, warehouse)


# Columns that the second generation of files lacks, and the date it starts at.
_ABSENT = ("pre_close", "amount", "circulation_market_value", "total_market_value")
_SECOND_FROM = "2021-01-01"
_SECOND_COLUMNS = tuple(f.name for f in _CONTRACT_FIELDS if f.name not in (*_ABSENT, "turnover_rate", "avg_price"))

@register("daily_job_absent_columns", O.with_raw(O.CLEAN_CTES + f""",
raw_bars_2 AS (
  SELECT src, trade_date, code, name, open, high, low, close + 1.0 AS close, NULL::DOUBLE AS pre_close, volume,
         NULL::DOUBLE AS amount, NULL::DOUBLE AS circulation_market_value, NULL::DOUBLE AS total_market_value
  FROM raw_bars WHERE trade_date >= DATE '{_SECOND_FROM}'),{SECOND_CTES},
_both AS ({O.merge_sql("clean_daily", "clean_daily_2", K.DAILY_KEYS, tuple(f.name for f in _CONTRACT_FIELDS), _SECOND_COLUMNS)})""",
    f"SELECT {', '.join(_decimal_sql(f) for f in _CONTRACT_FIELDS)} FROM _both"))
def daily_job_absent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 + U1 + U4: a second generation of files without optional columns updates the rest.

    Stored values of the columns those files lack, and of what is derived from them, stay.
    """
    warehouse = _scratch(spark, "absent-warehouse")
    bars = raw_bars(spark, sf_dir)
    first, second = _scratch(spark, "absent-first"), _scratch(spark, "absent-second")
    write_quote_files(bars, first)
    run_daily(spark, first, warehouse, recursive=True)
    later = bars.where(F.col("trade_date") >= F.lit(_SECOND_FROM).cast("date")).withColumn("close", F.col("close") + 1.0)
    write_quote_files(later, second, absent=_ABSENT)
    run_daily(spark, second, warehouse, recursive=True)
    return _stored(spark, warehouse)


@register("step_chain", O.with_clean("SELECT " + ", ".join(
    _decimal_sql(f) if f.name != "total_market_value" else "NULL::DECIMAL(20,2) AS total_market_value" for f in _CONTRACT_FIELDS)
    + " FROM clean_daily"))
def step_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2 + X3 + X4 + S12: Chinese headers through adapt, a per-series step, clean and save; the stored table."""
    warehouse = _scratch(spark, "chain-warehouse")
    raw = raw_bars_cn(spark, sf_dir)
    same = per_series(lambda pdf: pdf, raw.schema, max_rows=100_000)
    table = ParquetTable.daily(spark, warehouse)
    Pipeline.create([same, AdaptStep(), CleanStep(), SaveStep(table)]).run(raw)
    return _stored(spark, warehouse)


# The wide files: sixty columns from each line item, the second layout in reverse order without the last ten.
_WIDE = [f"k{i:02d}" for i in range(60)]


@register("plain_csv_load", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       CAST(l_partkey AS VARCHAR) AS k00, CAST(l_partkey + 49 AS VARCHAR) AS k49,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey + 59 AS VARCHAR) END AS k59,
       CAST(CASE WHEN l_linenumber % 2 = 0 THEN 60 ELSE 50 END AS INTEGER) AS n_filled
FROM lineitem""")
def plain_csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S5: plain CSV files of two layouts, up to 62 columns, loaded and united by name."""
    folder = _scratch(spark, "plain")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey"), F.col("l_linenumber"), *[(F.col("l_partkey") + i).alias(c) for i, c in enumerate(_WIDE)])
    even = F.col("l_linenumber") % 2 == 0
    # Wide text takes many times the table's space: the files are packed, and so small that each is one task's work.
    for name, part in (("even", items.where(even)), ("odd", items.where(~even).select(*reversed(items.columns[:52])))):
        part.write.option("header", "true").options(compression="gzip", maxRecordsPerFile=50_000, **{"zlib.compress.level": "BEST_SPEED"}).csv(f"{folder}/{name}")
    loaded = load_csv(spark, folder, "*.csv.gz")
    filled = functools.reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in _WIDE])
    return loaded.select("l_orderkey", "l_linenumber", "k00", "k49", "k59", filled.alias("n_filled"))


@register("stream_ingest", _TABLE_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + R2: the same files ingested by an availableNow file stream, 25 files per micro-batch."""
    folder, warehouse = _scratch(spark, "stream-files"), _scratch(spark, "stream-warehouse")
    write_quote_files(raw_bars(spark, sf_dir), folder)
    q = start_ingest(spark, folder, warehouse, stream_checkpoint=_scratch(spark, "stream-ckpt"),
                     max_files_per_trigger=25, recursive=True)
    q.awaitTermination()
    return _stored(spark, warehouse)


# -- factors on the cleaned bars (D1-D5, D7, D9) --------------------------------

def _r6(c):
    """Six decimals, rounded the same way in both engines (``round`` differs on ties).

    Spark's ``floor`` gives a long, so values beyond whole doubles, infinite ones and NaN pass as they are.
    """
    x = c * 1e6 + 0.5
    return F.when(F.abs(x) < 2.0 ** 53, F.floor(x)).otherwise(x) / 1e6


def _r6_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_bars(raw_bars(spark, sf_dir)).clean().drop(K.SRC)


_W = "PARTITION BY code ORDER BY trade_date"


def _roll_sql(x: str, n: int) -> str:
    w = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN avg({x}) OVER {w} END"


@register("ma", O.with_clean(
    f"SELECT code, trade_date, {_r6_sql(_roll_sql('close', 5))} AS ma5, "
    f"{_r6_sql(_roll_sql('close', 20))} AS ma20 FROM clean_daily"))
def ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5- and 20-day moving averages of the close."""
    out = FX.moving_averages(_bars(spark, sf_dir))
    return out.select("code", "trade_date", _r6(F.col("ma5")).alias("ma5"), _r6(F.col("ma20")).alias("ma20"))


@register("anomaly_filter", O.with_clean("""
SELECT code, trade_date FROM (
  SELECT code, trade_date, close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1.0 AS p
  FROM clean_daily WHERE close > 0 AND volume > 0) WHERE abs(p) <= 0.20::DOUBLE"""))
def anomaly_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive close and volume, then changes within ±20 % (first row has none and goes)."""
    return FX.anomaly_filter(_bars(spark, sf_dir)).select("code", "trade_date")


@register("drop_any_null", O.with_clean(
    "SELECT code, trade_date FROM clean_daily WHERE close > 0 AND " + " AND ".join(
        f"{c} IS NOT NULL" for c in ("trade_date", "code", "name", "open", "high", "low", "close", "pre_close",
                                     "volume", "amount", "circulation_market_value", "total_market_value",
                                     "pct_change", "turnover_rate", "avg_price", "trading_days"))))
def drop_any_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: rows without any NULL and with a positive close."""
    return FX.drop_any_null(_bars(spark, sf_dir)).select("code", "trade_date")


_TR_SQL = """greatest(high - low, coalesce(abs(high - lag(close) OVER (PARTITION BY code ORDER BY trade_date)),
                        high - low),
                      coalesce(abs(low - lag(close) OVER (PARTITION BY code ORDER BY trade_date)), high - low))"""


@register("atr", O.with_clean(
    f"SELECT code, trade_date, {_r6_sql(_roll_sql('tr', 14))} AS atr_14 "
    f"FROM (SELECT *, {_TR_SQL} AS tr FROM clean_daily)"))
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """14-day average true range (simple mean)."""
    return FX.atr(_bars(spark, sf_dir)).select("code", "trade_date", _r6(F.col("atr_14")).alias("atr_14"))


@register("rsi_sma", O.with_clean(f"""
SELECT code, trade_date,
       {_r6_sql("CASE WHEN ag IS NULL THEN NULL WHEN al = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ag / al) END")}
         AS rsi_14
FROM (SELECT code, trade_date, {_roll_sql('g', 14)} AS ag, {_roll_sql('l', 14)} AS al
      FROM (SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0 END AS g,
                      CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0 END AS l
            FROM (SELECT *, close - lag(close) OVER ({_W}) AS d FROM clean_daily)))"""))
def rsi_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """14-day RSI with simple means of gains and losses."""
    return FX.rsi(_bars(spark, sf_dir)).select("code", "trade_date", _r6(F.col("rsi_14")).alias("rsi_14"))


@register("adjusted_price", O.with_clean(f"""
SELECT code, trade_date, {_r6_sql('exp(cum)')} AS adj_factor,
       {_r6_sql('close * exp(max_by(cum, trade_date) OVER (PARTITION BY code) - cum)')} AS adj_close
FROM (SELECT *, sum(floor(ln(CASE WHEN pre_close > 0 AND prev > 0 THEN pre_close / prev ELSE 1.0 END) * 1e12 + 0.5))
                  OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e12 AS cum
      FROM (SELECT *, lag(close) OVER ({_W}) AS prev FROM clean_daily))"""))
def adjusted_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-adjusted close from the pre_close / previous-close ratios."""
    out = FX.adjusted_close(_bars(spark, sf_dir))
    return out.select("code", "trade_date", _r6(F.col("adj_factor")).alias("adj_factor"),
                      _r6(F.col("adj_close")).alias("adj_close"))


@register("drawdown", O.with_clean(f"""
SELECT code, trade_date,
       {_r6_sql("close / first_value(close) OVER (" + _W + ")")} AS equity,
       {_r6_sql("1.0 - close / max(close) OVER (" + _W + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")}
         AS drawdown
FROM clean_daily"""))
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity curve and drawdown from the running peak."""
    out = FX.drawdown(_bars(spark, sf_dir))
    return out.select("code", "trade_date", _r6(F.col("equity")).alias("equity"),
                      _r6(F.col("drawdown")).alias("drawdown"))


@register("performance", O.with_clean(f"""
SELECT code, days, {_r6_sql('mean')} AS mean_return, {_r6_sql('vol')} AS volatility, {_r6_sql('dd')} AS max_drawdown,
       {_r6_sql('CASE WHEN vol > 0 THEN mean / vol * sqrt(252::DOUBLE) END')} AS sharpe
FROM (SELECT code, count(*) AS days, avg(pct_change) AS mean, stddev_samp(pct_change) AS vol, max(dd) AS dd
      FROM (SELECT code, pct_change,
                   1.0 - close / max(close) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd
            FROM clean_daily) GROUP BY code)"""))
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per code trading days, mean and volatility of the changes, Sharpe ratio and maximum drawdown."""
    out = FX.performance(_bars(spark, sf_dir))
    return out.select("code", "days", *[_r6(F.col(c)).alias(c) for c in ("mean_return", "volatility", "max_drawdown", "sharpe")])


def _ewm_sql(span: int) -> tuple[str, str]:
    """``alpha`` and the next value of pandas' ``ewm(span, adjust=False).mean()`` as SQL."""
    alpha = f"(1.0 / (1.0 + ({span} - 1) / 2.0))"
    return alpha, f"(1.0 - {alpha})"


def _macd_sql() -> str:
    a12, b12 = _ewm_sql(12)
    a26, b26 = _ewm_sql(26)
    a9, b9 = _ewm_sql(9)

    def step(prev: str, x: str, a: str, b: str) -> str:
        return f"CASE WHEN {prev} = {x} THEN {prev} ELSE ({b} * {prev} + {a} * {x}) / ({b} + {a}) END"

    return "WITH RECURSIVE " + O.RAW_BARS_SQL + "," + O.CLEAN_CTES + f""",
_s AS (SELECT code, trade_date, close, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS rn
       FROM clean_daily),
_e AS (
  SELECT code, rn, trade_date, close, close AS e12, close AS e26 FROM _s WHERE rn = 1
  UNION ALL
  SELECT s.code, s.rn, s.trade_date, s.close, {step('e.e12', 's.close', a12, b12)},
         {step('e.e26', 's.close', a26, b26)}
  FROM _e e JOIN _s s ON s.code = e.code AND s.rn = e.rn + 1),
_g AS (
  SELECT code, rn, trade_date, close, e12 - e26 AS macd, e12 - e26 AS sig FROM _e WHERE rn = 1
  UNION ALL
  SELECT m.code, m.rn, m.trade_date, m.close, m.e12 - m.e26, {step('g.sig', '(m.e12 - m.e26)', a9, b9)}
  FROM _g g JOIN _e m ON m.code = g.code AND m.rn = g.rn + 1)
SELECT code, trade_date, {_r6_sql('close')} AS close, {_r6_sql('macd')} AS macd,
       {_r6_sql('sig')} AS macd_signal, {_r6_sql('macd - sig')} AS macd_hist
FROM _g"""


@register("macd", _macd_sql())
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD(12, 26, 9) per code with pandas exponential means; SQL restates the recursion."""
    out = FX.macd(_bars(spark, sf_dir))
    return out.select("code", "trade_date", *[_r6(F.col(c)).alias(c)
                                              for c in ("close", "macd", "macd_signal", "macd_hist")])
