"""The retry folder: bodies that couldn't be delivered, each a compressed file with the byte ranges of its lines, read again when due."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.rules import retry_due
from sluiceway.sources import files
from sluiceway.sources.text import file_uri

ENDING = ".retry"


def retry_name(epoch: Column, *parts: Column) -> Column:
    """``<epoch>_<uuid>.retry``; the uuid is made of the parts, so a task that runs again writes the same file."""
    h = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(epoch.cast("long").cast("string"), F.lit("_"), dashed, F.lit(ENDING))


def packed(body: str, offsets: str | None) -> bytes:
    """A file's contents: the ranges (JSON, or any text) and the body."""
    return gzip.compress(json.dumps({"offsets": offsets, "body": body}).encode(), 1)


def unpacked(data: bytes) -> tuple[str | None, str | None]:
    """(body, offsets) of a file's contents, which are gzip or, if they aren't, plain text."""
    try:
        data = gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        pass
    try:
        said = json.loads(data.decode("utf-8", "replace"))
    except ValueError:
        return None, None
    return said.get("body"), said.get("offsets")


def write_files(failed: DataFrame, folder: str, epoch: Column) -> DataFrame:
    """One file for each body (stream, batch_id, body, offsets), written by the tasks under its final name once whole: rows (name, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for name, body, offsets in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = packed(body, offsets)
                files.write_whole(folder, name, data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    named = failed.select(retry_name(epoch, F.col("stream"), F.col("batch_id")).alias("name"), "body", F.col("offsets").cast("string").alias("offsets"))
    return named.mapInArrow(run, "name string, bytes bigint")


def read_files(spark: SparkSession, folder: str, now_epoch: Column, base_delay: int) -> DataFrame:
    """Files ``<epoch>_<uuid>.retry`` of a sufficient age: name, path, body, offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [unpacked(data) for data in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[k] for x in said], pa.string()) for k in (0, 1)]], ["name", "path", "body", "offsets"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").load(folder)
    name = F.substring_index("path", "/", -1)
    ready = found.withColumn("name", name).where(retry_due(F.col("name"), now_epoch, base_delay))
    return ready.select("name", file_uri(F.col("path")).alias("path"), "content").mapInArrow(run, "name string, path string, body string, offsets string")


def delete_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Deletes files from the tasks; rows (path, deleted). A file that is gone already is no error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [files.remove(*p.rsplit("/", 1)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.bool_())], ["path", "deleted"])

    return paths.select(F.col(path).alias("path")).mapInArrow(run, "path string, deleted boolean")


def stored_bytes(folder: str) -> int:
    """What the bodies that wait take up; bodies of micro-batches that aren't done don't count."""
    return sum(i.size for i in files.files_in(folder, ENDING))


def keep_within(names: list[tuple[str, int]], limit: int | None, used: int) -> tuple[list[str], list[str]]:
    """Files (name, bytes) in order of arrival to those that are kept and those that are dropped: a file that would lead beyond the limit counts for nothing."""
    kept, dropped = [], []
    for name, size in names:
        fits = limit is None or used + size <= limit
        used += size if fits else 0
        (kept if fits else dropped).append(name)
    return kept, dropped
