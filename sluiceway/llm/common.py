"""Small shared pieces: word splitting, lineage cuts in the shared folder, size helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sluiceway-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The same rows with their lineage cut: written as Parquet to the shared folder, and read again.

    A written table survives lost executors; its readers depend on nothing that ran before. Writers and readers hold a
    row group at a time: ``group_rows`` is the most rows of one, for tables of large rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    written = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", str(group_rows))
    written.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """The rows, written, with a number of their own each: an identity that holds where keys are null or repeated."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def identified(df: DataFrame) -> DataFrame:
    """Each row as one struct, ``row``, with ``__f`` and ``__i``, an identity that holds where keys are null or repeated.

    As the caller's columns stay inside the struct, none is taken for one of ours, whatever its name. Of rows that come straight from files the identity
    is the file and the place in it, which costs no copy; it is looked at whether all are different, as rows that were joined or repeated share theirs. Other rows
    are written with numbers.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    try:
        known = df.select(row, F.xxhash64("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").cast("long").alias("__i"))
    except AnalysisException:  # no files, or none that number their rows
        known = None
    if known is None or known.groupBy("__f", "__i").count().where("count > 1 OR __i IS NULL").limit(1).count():
        return numbered(df.select(row), "__i").withColumn("__f", F.lit(0).cast("long"))
    return known


def of_row(name: str) -> Column:
    """A column of the caller's, of rows that ``identified`` gives."""
    return F.col("row").getField(name)


#: Keys with more than this share of all rows are split. No more than 1 / HOT keys can have it, which bounds their broadcast.
HOT = 1 / 1000


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, by: str, how: str = "inner") -> DataFrame:
    """Rows joined with one row for each key, where a key may hold any share of all rows.

    ``count`` is per_key's column with the number of ``rows`` of the key, ``total`` their sum. The rows of a hot key are
    dealt, by the column ``by``, over as many parts as they have shares of HOT, and its one row is copied to each part.
    """
    part = max(1, int(total * HOT))
    parts = F.ceil(F.col(count) / part).cast("int")
    hot = per_key.where(F.col(count) > part).select(F.col(key).alias("__hot"), parts.alias("__parts"))  # 1 / HOT rows at most
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__part", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("__parts"))).cast("int")).drop("__hot", "__parts")
    copied = per_key.withColumn("__part", F.explode(F.when(F.col(count) > part, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, "__part"], how).drop("__part")


#: About as many rows as are numbered in one task.
RUN = 20_000


def ranked(rows: DataFrame, group: list[str], by: list[str], total: int, row: str = "__row", name: str = "__rank") -> DataFrame:
    """Written rows with their places, from 0 without gaps, in each group, whatever share of all rows a group or a value of ``by`` holds.

    A group's rows are dealt to runs by a hash of ``by``, and runs that come out too long are dealt again by the row's number;
    places count the runs before, then inside the run in the order of ``by``.
    """
    runs = max(1, -(-total // RUN))
    dealt = rows.withColumn("__run", F.struct(*group, F.pmod(F.xxhash64(*by, F.lit("run")), F.lit(runs)).alias("__r")))
    sizes = dealt.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    dealt = spread_join(dealt, sizes, "__run", "__n", total, row).withColumn("__piece", F.pmod(F.xxhash64(row), F.ceil(F.col("__n") / RUN)).cast("int")).drop("__n")
    counts = dealt.groupBy("__run", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*[f"__run.{g}" for g in group]).orderBy("__run.__r", "__piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for each run
    starts = counts.select("__run", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__run", "__piece").orderBy(*by, row)
    placed = dealt.withColumn("__at", F.row_number().over(inside) - 1).join(starts, ["__run", "__piece"])
    return placed.withColumn(name, F.col("__start") + F.col("__at")).drop("__run", "__piece", "__start", "__at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batch_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Arrow batches of few rows for what is executed inside; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows, so that what is made of long texts is let go of soon. Spark bounds the batches that
    come in by bytes; nothing is set in the caller's session."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
