"""Sinks for streams."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stream_folder(spark: SparkSession) -> str:
    """Where a stream keeps its state: spark.checkpoint.dir, which all executors share; only a local master may do without."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return f"{folder}/streams"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="streams-")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, for tables that several later steps read."""
    path = f"{stream_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for what is there now, as Parquet in a folder: for bounded inputs."""
    path = f"{folder}/{uuid.uuid4().hex}"
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def append_scores(stream: DataFrame, table: str, checkpoint: str):
    """Starts a stream into a table; each batch is written once, even if it is tried again."""
    return stream.writeStream.option("checkpointLocation", checkpoint).toTable(table)
