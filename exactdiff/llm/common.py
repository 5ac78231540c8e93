"""What the operators share: reading, cutting lineage, and choosing between a broadcast and a shuffle."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many rows of a few numbers each (some 10 MB).
BROADCAST_ROWS = 200_000
#: Tasks for so few rows, and shuffle partitions that one task counts. The driver keeps a record of every task, so hundreds of
#: them for a handful of rows each cost it more than the rows do.
FEW, COUNTED = 8, 16
#: Bytes of an Arrow batch, and where Spark looks for them.
BATCH_BYTES, BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"exactdiff-{uuid.uuid4().hex}"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and without their lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few rows, else unchanged, so that Spark shuffles it. df should be cut
    beforehand: its rows are counted here unless their number is given."""
    n = counted(df) if rows is None else rows
    return F.broadcast(df.coalesce(FEW)) if n <= BROADCAST_ROWS else df


def counted(df: DataFrame) -> int:
    """The number of rows of df, which should be cut beforehand: a task counts several partitions."""
    return df.coalesce(max(FEW, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // COUNTED)).count()


def cut_narrow(df: DataFrame, few: bool = False) -> DataFrame:
    """cut(df), whose rows are a few numbers each, in FEW partitions if it has few rows; few: whether that is known."""
    if few:
        return cut(df.coalesce(FEW))
    done = cut(df)
    return done.coalesce(FEW) if counted(done) <= BROADCAST_ROWS else done


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of BATCH_BYTES, unless the session names another size: 10,000 whole
    texts, Spark's bound of rows, are held several times over by an executor and its workers."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that nothing uses any more. It does so when the
    driver's JVM collects garbage, and a driver with room to spare seldom does that in the middle of many small steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that clashes with none of those taken, whatever their case."""
    lower = {x.lower() for x in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps what it has
        pass
