"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import itertools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Configs a job needs regardless of where it runs.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # GBK decoding of the quote files needs the legacy charset list (Spark 4).
    "spark.sql.legacy.javaCharsets": "true",
    # ... and undecodable bytes must mark their own file, not fail the scan.
    "spark.sql.legacy.codingErrorAction": "true",
    # HotSpot does not JIT methods over 8000 bytes; a whole-stage method above that
    # runs interpreted, so let such stages fall back to per-operator code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A folder of many small files: a task lists and reads some hundreds of them, not one or thirty.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    "spark.sql.files.openCostInBytes": str(256 * 1024),
    # Spark refuses a Python connector that takes pushed filters unless they are on.
    "spark.sql.python.filterPushdown.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "barsmith") -> SparkSession:
    """A local session for tests and benchmarks (UI off, small shuffle width)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("BARSMITH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the job configs to a live session (safe to call repeatedly)."""
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names; set one only when unset (tests)."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder as fallback")
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


class Scratch:
    """Frames of one run, each written once as Parquet (zstd) under the shared checkpoint folder and read back.

    An eager checkpoint runs a plan's last stage twice, once to count its rows and once to store them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._number = spark, f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}", itertools.count()

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{next(self._number)}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete the frames; nothing may read them any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
