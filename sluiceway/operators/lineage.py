"""Tables written between the steps of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where that isn't set, a local master gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sluiceway-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: what was before isn't run twice, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
