"""Table contracts, column names and the fixed values the cleaning rules depend on.

Everything a job needs to agree on lives here: the header map of the CSV layout,
the NA tokens of the CSV reader, the numeric columns that get coerced, the
price-limit constants, and the ``StructType`` of each stored table with its keys.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# CSV header (Chinese) -> standard column name, in the order the adapter keeps them.
HEADER_MAP: dict[str, str] = {
    "交易日期": "trade_date",
    "股票代码": "code",
    "股票名称": "name",
    "开盘价": "open",
    "最高价": "high",
    "最低价": "low",
    "收盘价": "close",
    "前收盘价": "pre_close",
    "成交量": "volume",
    "成交额": "amount",
    "流通市值": "circulation_market_value",
    "总市值": "total_market_value",
}

# Cells the CSV reader treats as missing (the pandas ``read_csv`` defaults).
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Columns coerced to double by the cleaner.
NUMERIC_COLUMNS: tuple[str, ...] = (
    "open", "high", "low", "close", "volume", "amount", "pre_close",
    "circulation_market_value", "total_market_value",
)

# Columns whose nulls drop a row: identifiers first, prices after positioning.
IDENTIFIER_COLUMNS: tuple[str, ...] = ("trade_date", "code")
PRICE_COLUMNS: tuple[str, ...] = ("open", "high", "low", "close", "volume")

# Price-limit thresholds by board, the tolerance added on top, and the day the
# ChiNext (sz30) rule changed: the new limit applies to dates after this one.
LIMIT_DEFAULT = 0.10
LIMIT_BJ = 0.30
LIMIT_STAR = 0.20        # sh68
LIMIT_CHINEXT_NEW = 0.20  # sz30 after the switch
LIMIT_ST = 0.05
LIMIT_TOLERANCE = 0.02
CHINEXT_SWITCH_DATE = "2020-08-23"
PREFIX_BJ = "bj"
PREFIX_STAR = "sh68"
PREFIX_CHINEXT = "sz30"
ST_MARK = "ST"
# A last name containing either of these marks a delisted series.
DELIST_MARKS: tuple[str, ...] = ("退", "S")

# Length limits of the stored string columns.
CODE_MAX_LEN = 15
NAME_MAX_LEN = 50

# Manifest statuses and the allowed transitions between them (None = no row yet).
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
STATUSES: tuple[str, ...] = (PENDING, PROCESSING, COMPLETED, FAILED)
TRANSITIONS: dict[str | None, frozenset[str]] = {
    None: frozenset({PENDING, PROCESSING}),
    PENDING: frozenset({PROCESSING, FAILED}),
    PROCESSING: frozenset({COMPLETED, FAILED}),
    FAILED: frozenset({PROCESSING}),
    COMPLETED: frozenset({PROCESSING}),
}
STALE_TIMEOUT_MINUTES = 60

# Identifier checks of the upsert (table names may carry a schema prefix).
TABLE_NAME_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_.]*$"
COLUMN_NAME_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_]*$"

# ---------------------------------------------------------------------------
# Derived names
# ---------------------------------------------------------------------------

STANDARD_COLUMNS: tuple[str, ...] = tuple(HEADER_MAP.values())
REQUIRED_COLUMNS: tuple[str, ...] = IDENTIFIER_COLUMNS + PRICE_COLUMNS
OPTIONAL_COLUMNS: tuple[str, ...] = tuple(c for c in STANDARD_COLUMNS if c not in REQUIRED_COLUMNS)
DERIVED_COLUMNS: tuple[str, ...] = ("pct_change", "turnover_rate", "avg_price", "trading_days")

SRC = "src"  # series key: one source file = one series


def presence_flag(column: str) -> str:
    """Name of the per-row flag telling whether a source carried ``column``."""
    return f"_has_{column}"


PRESENCE_FLAGS: tuple[str, ...] = tuple(presence_flag(c) for c in STANDARD_COLUMNS)

# Schema of the adapted, coerced bars (what the cleaner consumes).
BAR_SCHEMA = T.StructType(
    [T.StructField(SRC, T.StringType())]
    + [T.StructField("trade_date", T.DateType()), T.StructField("code", T.StringType()),
       T.StructField("name", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ("open", "high", "low", "close", "pre_close", "volume", "amount",
        "circulation_market_value", "total_market_value")]
)

# ---------------------------------------------------------------------------
# Stored tables
# ---------------------------------------------------------------------------

PRICE = T.DecimalType(10, 2)
AMOUNT = T.DecimalType(20, 2)
RATIO = T.DecimalType(10, 6)

DAILY_KEYS: tuple[str, ...] = ("code", "trade_date")
DAILY_SCHEMA = T.StructType([
    T.StructField("open", PRICE), T.StructField("high", PRICE),
    T.StructField("low", PRICE), T.StructField("close", PRICE),
    T.StructField("pre_close", PRICE), T.StructField("volume", AMOUNT),
    T.StructField("amount", AMOUNT), T.StructField("name", T.StringType()),
    T.StructField("circulation_market_value", AMOUNT),
    T.StructField("total_market_value", AMOUNT),
    T.StructField("pct_change", RATIO), T.StructField("turnover_rate", RATIO),
    T.StructField("avg_price", PRICE), T.StructField("trading_days", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("trade_date", T.DateType(), False),
])

# The minute table stores its time of day as seconds since midnight.
MINUTE_KEYS: tuple[str, ...] = ("code", "trade_date", "time")
MINUTE_SCHEMA = T.StructType([
    T.StructField("open", PRICE), T.StructField("high", PRICE),
    T.StructField("low", PRICE), T.StructField("close", PRICE),
    T.StructField("volume", AMOUNT), T.StructField("amount", AMOUNT),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("trade_date", T.DateType(), False),
    T.StructField("time", T.IntegerType(), False),
])

MANIFEST_KEYS: tuple[str, ...] = ("source_identifier",)
MANIFEST_SCHEMA = T.StructType([
    T.StructField("source_identifier", T.StringType(), False),
    T.StructField("source_hash", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("processed_at", T.TimestampNTZType()),
    T.StructField("reason", T.StringType()),
])

TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "stock_daily": (DAILY_SCHEMA, DAILY_KEYS),
    "stock_minute": (MINUTE_SCHEMA, MINUTE_KEYS),
    "etl_metadata": (MANIFEST_SCHEMA, MANIFEST_KEYS),
}
AUDIT_COLUMNS: tuple[str, ...] = ("created_at", "updated_at")
