"""The source contract (S9): how a job finds units of input and reads them.

A source answers two questions with DataFrames, never with driver-side loops:

* ``listing(spark)`` — one row per unit (``source_identifier``, ``source_hash``,
  ``file_size``, ``modification_time``), the input of the manifest;
* ``read(spark, identifiers)`` — the rows of the units in the frame ``identifiers`` (``source_identifier``) in the standard
  bar layout with a ``src`` column and presence flags.

``CsvQuoteSource`` is the quote-file source. ``ParquetBarsSource`` reads bar
tables (one series per value of a key column), showing that any Spark-readable
format fits the same job. A connector Spark does not know is written with the
Python data source API (see :mod:`barsmith.sources.custom`).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as K
from ..operators.adapt import to_standard_frame
from .csv import ReaderRules, list_sources, scan


class Source(Protocol):
    def listing(self, spark: SparkSession) -> DataFrame: ...

    def read(self, spark: SparkSession, identifiers: DataFrame) -> DataFrame: ...


@dataclass
class CsvQuoteSource:
    path: str
    pattern: str = "*.csv"
    recursive: bool = False
    encoding: str = "GBK"
    rules: ReaderRules = ReaderRules()

    def listing(self, spark: SparkSession) -> DataFrame:
        return list_sources(spark, self.path, self.pattern, self.recursive)

    def read(self, spark: SparkSession, identifiers: DataFrame) -> DataFrame:
        # Spark's file index holds the paths on the driver in any case.
        paths = [r[0] for r in identifiers.select("source_identifier").collect()]
        return scan(spark, paths, self.encoding, listing=identifiers, rules=self.rules).rows


@dataclass
class ParquetBarsSource:
    """Bars stored in Parquet; each value of ``series_column`` is one source."""

    path: str
    series_column: str = K.SRC

    def listing(self, spark: SparkSession) -> DataFrame:
        """One row per series: rows and latest file time as the fingerprint, bytes of its files."""
        df = spark.read.parquet(self.path).select(
            F.col(self.series_column).alias("source_identifier"), F.col("_metadata.file_path").alias("_f"),
            F.col("_metadata.file_size").alias("_s"), F.col("_metadata.file_modification_time").alias("_t"))
        per_file = df.groupBy("source_identifier", "_f").agg(
            F.count(F.lit(1)).alias("_n"), F.max("_s").alias("_s"), F.max("_t").alias("_t"))
        return (per_file.groupBy("source_identifier")
                .agg(F.sum("_n").alias("_n"), F.max("_t").alias("modification_time"), F.sum("_s").alias("file_size"))
                .select("source_identifier",
                        F.concat_ws(":", F.col("_n").cast("string"),
                                    F.unix_micros("modification_time").cast("string")).alias("source_hash"),
                        "file_size", "modification_time"))

    def read(self, spark: SparkSession, identifiers: DataFrame) -> DataFrame:
        df = spark.read.parquet(self.path).withColumnRenamed(self.series_column, K.SRC)
        chosen = identifiers.select(F.col("source_identifier").alias(K.SRC))
        return to_standard_frame(df.join(chosen, K.SRC, "left_semi"))
