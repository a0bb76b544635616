"""Text files and text columns as lines with byte ranges."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_lines(texts: DataFrame, text: str = "text", whole_only: bool = False) -> DataFrame:
    """Each row's text as lines: n (from 0), line (without its \\n; \\r stays).

    ``whole_only`` leaves out a last line that has no \\n yet.
    """
    others = [c for c in texts.columns if c != text]
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    split = texts.withColumn("__p", parts)
    rows = split.select(*others, text, F.posexplode("__p").alias("n", "line"), F.size("__p").alias("__of"))
    rows = rows.withColumn("__last", F.col("n") == F.col("__of") - 1).where("NOT __last" if whole_only else "NOT __last OR line <> '' OR __of = 1")
    return rows.select(*others, "n", "line")


def with_offsets(lines: DataFrame, key: str, order: str = "n", line: str = "line") -> DataFrame:
    """Adds start and end: the half-open byte range of each line in its file, \\n included."""
    size = F.octet_length(line).cast("long") + 1
    until = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("end", until).withColumn("start", F.col("end") - size)


def read_text(spark: SparkSession, paths: list[str], rules=None) -> DataFrame:
    """Lines of files below directories: line, file. Only \\n ends a line; invalid UTF-8 becomes U+FFFD.

    ``rules`` (path rules) prune after the listing; a file's name is known without opening it.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
    named = raw.select(F.make_valid_utf8("value").alias("line"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("file"))
    return named if rules is None else named.where(rules.passes(F.col("file")))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a directory: path, size, modified. Contents are not read. A directory that isn't there yet holds nothing."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, size bigint, modified timestamp")
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All lines of several sources; columns that one lacks are null."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def strip_cr(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def file_uri(path: Column) -> Column:
    """A path as Spark lists it, in the form that other readers take."""
    return F.regexp_replace(path, "^file:/+", "file:///")
