"""Cluster snapshots and events as JSON lines, with stated schemas, and records of a child process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.schema import EVENTS, NODES, PODS


def read_pods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PODS).json(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).json(path)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(EVENTS).json(path)


def read_process_output(spark: SparkSession, path: str, file: str = "winevt_tailer") -> DataFrame:
    """Captured output of a tailer process: records end at \\n or \\r\\n and are trimmed; empty ones are left out."""
    raw = spark.read.text(path)
    return raw.select(F.trim("value").alias("line"), F.lit(file).alias("file")).where("line <> ''")
