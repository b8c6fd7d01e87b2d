"""The standard steps as pipeline handlers: adapt → clean → save.

They let a chain be written the way the reference's daily job is wired::

    Pipeline.create([AdaptStep(), CleanStep(), SaveStep(ParquetTable.daily(spark, root))]).run(raw)

Each step maps a DataFrame to a DataFrame. The cleaner counts rows per series when it is
built (to split huge ones); everything else runs at the save.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..operators.adapt import to_standard_frame
from ..operators.clean import OUTPUT_COLUMNS, PRESENT, CleanResult, clean_bars, coerce_types
from ..operators.series import DEFAULT_MAX_ROWS
from ..operators.upsert import latest_per_key
from ..session import checkpoint_dir
from ..sources.tables import ParquetTable


class AdaptStep:
    """P1 + P2: Chinese headers to standard names, standard columns only (absent ones NULL)."""

    def handle(self, df: DataFrame) -> DataFrame:
        return to_standard_frame(df)


@dataclass
class CleanStep:
    """The cleaner; quarantined sources are dropped and kept on ``last_result``.

    Its rows carry the flags of :data:`PRESENT`, so that the save leaves stored
    values alone where a source lacks a column.
    """

    max_series_rows: int = DEFAULT_MAX_ROWS
    quarantine_first_row_dropped: bool = True
    last_result: CleanResult | None = field(default=None, repr=False)

    def handle(self, df: DataFrame) -> DataFrame:
        std = coerce_types(df) if K.presence_flag("code") in df.columns else None
        self.last_result = clean_bars(std if std is not None else df, standardized=std is not None,
                                      max_series_rows=self.max_series_rows,
                                      quarantine_first_row_dropped=self.quarantine_first_row_dropped)
        return self.last_result.clean(presence=True)


@dataclass
class SaveStep:
    """Upsert into the table on its keys and return the input unchanged.

    An empty input is skipped. Keys delivered by more than one source keep the
    row of the greatest source identifier (a stand-in for file time when the
    frame carries none).
    """

    table: ParquetTable

    def handle(self, df: DataFrame) -> DataFrame:
        rows = df
        if K.SRC in df.columns:
            rows = latest_per_key(df, self.table.keys, [F.col(K.SRC)], present=PRESENT)
        stored = rows.select(*[c for c in (*OUTPUT_COLUMNS, *PRESENT.values()) if c != K.SRC and c in rows.columns])
        checkpoint_dir(df.sparkSession)
        self.table.upsert(stored.checkpoint(), present=PRESENT)  # the upsert reads it more than once
        return df
