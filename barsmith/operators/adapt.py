"""Column adaptation (operators P1-P4): standard names, standard column set.

The reference renames the Chinese headers and keeps the standard columns that
exist. A Spark plan wants one fixed schema, so absent columns become typed NULLs
and a per-row presence flag records whether the source really carried them (an
absent column is not a NULL column: it disables rules and keeps stored values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as K


def rename_headers(df: DataFrame) -> DataFrame:
    """Exact-match rename of the CSV headers to standard names."""
    return df.withColumnsRenamed({h: n for h, n in K.HEADER_MAP.items() if h in df.columns})


def keep_standard(df: DataFrame, key: str | None = K.SRC) -> DataFrame:
    """Keep the standard columns that exist, in mapping order; drop the rest."""
    keep = [c for c in K.STANDARD_COLUMNS if c in df.columns]
    lead = [key] if key and key in df.columns else []
    return df.select(*lead, *keep)


def to_standard_frame(df: DataFrame, key: str = K.SRC) -> DataFrame:
    """P1 + P2 into the fixed layout: all 12 standard columns plus presence flags.

    Absent columns become NULL strings (the coercion step types them); existing
    presence flags (set per source by the CSV scan) are kept, missing ones are
    derived from the frame's own columns.
    """
    df = rename_headers(df)
    cols = [F.col(key)]
    for c in K.STANDARD_COLUMNS:
        cols.append(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c))
    for c in K.STANDARD_COLUMNS:
        flag = K.presence_flag(c)
        cols.append(F.col(flag) if flag in df.columns else F.lit(c in df.columns).alias(flag))
    return df.select(*cols)


def drop_helper(df: DataFrame, column: str = "price_limit_threshold") -> DataFrame:
    """Drop a helper column if present."""
    return df.drop(column)
