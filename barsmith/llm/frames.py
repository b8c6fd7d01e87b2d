"""Small DataFrame helpers shared by the text operators.

* ``pick`` selects input columns by position, so extra columns of any name
  (also ones that differ only in case) never clash with the operators' own.
* ``stage`` cuts lineage: it writes a frame as Parquet into the shared folder
  named by ``spark.checkpoint.dir`` and reads it back.
* ``with_block`` deals rows to blocks by a hash of their key; a block is the
  unit that one task holds in memory, so its number follows the input's size.
* ``complete_runs`` feeds a task whole key groups of a sorted partition, many
  small groups at a time.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.session import checkpoint_dir

#: Bytes of text that one block should hold.
BLOCK_BYTES = 12 << 20


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns of ``df`` under new names: ``pick(df, id="doc_id")``."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[plain[f"c{names.index(src)}"].alias(out) for out, src in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables; a local one only for a local master."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise
        return checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="barsmith-llm-"))


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back (lineage ends there)."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the staged table that ``df`` reads: it has been superseded by one already written."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[1].startswith("llm-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which an iterative job may not bring
    about for many rounds of shuffles.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def most_frequent(counted: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows of ``counted`` with the highest counts, at most ``limit``: those above a cut.

    The cut comes from a histogram of the counts in steps of a sixteenth of a power of
    two (about a thousand numbers at most reach the driver), so no task sorts all rows.
    ``counted`` is read twice; stage it first.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    rows = counted.groupBy(step.alias("step")).count().collect()
    cut, total = None, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["count"]
        if total > limit:
            break
        cut = r["step"]
    return counted.where(step >= cut) if cut is not None else counted.limit(0)


def block_count(df: DataFrame, text: str = "text", nbytes: int | None = None) -> int:
    """Blocks for ``df``: one per ``nbytes`` (BLOCK_BYTES) of its texts as they are (one scan of that column).

    The number follows the text alone: what each block says about the whole (its words, its
    pairs of classes) would otherwise grow with the width of the session's shuffles.
    """
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
    return max(1, -(-size // (nbytes or BLOCK_BYTES)))


def with_block(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """``df`` with column ``block``: a hash of ``key``, nulls in one block like any other value."""
    return df.withColumn("block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int"))


def complete_runs(batches: Iterable[pa.RecordBatch], key: str, rows: int = 200_000, nbytes: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole runs of ``key`` from a partition that is sorted by ``key``.

    Holds ``rows`` rows or ``nbytes`` bytes, whichever are reached first, plus at most one
    batch and the run that is still open.
    """
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        size += batch.nbytes
        if count < rows and size < nbytes:
            continue
        last = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(last, last[-1]))  # start of the open run in this batch
        if cut == 0:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
        else:
            done = [*held[:-1], batch.slice(0, cut)]
            yield pa.Table.from_batches(done)
            held = [batch.slice(cut)]
        count, size = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def run_starts(keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
