"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Prefix of columns that live only inside an operator, so that no input column clashes with them.
OWN = "__tr_"
#: Bytes of an Arrow batch between the JVM and a Python worker: both hold some at a time, and texts may be long.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local master may do without; a cluster may not."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return held.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyrule-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: no later failure recomputes it, and its size is known."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(run, spark: SparkSession):
    """run, for mapInArrow; at its end the worker, which lives on between stages, gives back the memory that it no longer needs.

    Where the session sets no size of its own for Arrow batches, it gets one, so that memory doesn't depend on how long
    texts are; results don't depend on it."""
    key, size = BATCH
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return whole


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored df with a broadcast hint if it has few enough rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
