"""Journal exports: text and binary fields, records apart by empty lines.

A file is read in ranges by many tasks. Where a record begins can't be seen from inside a file, as a binary value may hold empty lines, so each
range guesses: it reads from its first empty line on and notes at which record's end, at or behind its own end, it stops. A guess is right if
it is where the range before stopped; ranges that guessed wrong read again from there, until all fit. The first range knows its start, so each round settles more.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.operators.events import journal_app
from sluiceway.operators.lineage import cut
from sluiceway.sources.text import file_uri

NAME = re.compile(rb"[A-Z_][A-Z0-9_]*\Z")


def records(data: bytes | BinaryIO, start: int = 0, stop: int | None = None, ended: list[int] | None = None) -> Iterator[dict[str, bytes]]:
    """The records of an export, as they are read. A line that is no field spoils its record; reading goes on behind the next empty line.

    ``start`` is where a record begins; reading ends behind the first empty line that ends at ``stop`` or later, and ``ended`` is told where that was."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    size = source.seek(0, io.SEEK_END)
    source.seek(start)
    record, spoilt = {}, False
    while line := source.readline():
        line = line.removesuffix(b"\n")
        if not line:
            if record and not spoilt:
                yield record
            record, spoilt = {}, False
            if stop is not None and source.tell() >= stop:
                break
            continue
        if spoilt:
            continue
        name, equals, value = line.partition(b"=")
        if not NAME.match(name):
            spoilt = True
        elif equals:
            record[name.decode()] = value
        else:  # a length of 8 bytes, the value, a line end
            at = source.tell()
            head = source.read(8)
            length = struct.unpack("<Q", head)[0] if len(head) == 8 else None
            if length is None or at + 8 + length > size:
                spoilt = True
            else:
                value = source.read(length)
                spoilt = source.read(1) not in (b"\n", b"")
            if spoilt:
                source.seek(at)
            else:
                record[name.decode()] = value
    if record and not spoilt:
        yield record
    if ended is not None:
        ended.append(source.tell())


def guess(source: BinaryIO, start: int, stop: int) -> int | None:
    """The place behind the first empty line that ends in [start, stop), where a record may begin; None if there is none."""
    at = max(0, start - 2)
    source.seek(at)
    tail = b""
    while at < stop:
        piece = tail + source.read(min(1 << 20, stop - at))
        if len(piece) == len(tail):
            return None
        hit = piece.find(b"\n\n")
        if hit >= 0:
            return at - len(tail) + hit + 2 if at - len(tail) + hit + 2 < stop else None
        at += len(piece) - len(tail)
        tail = piece[-1:]
    return None


#: Bytes of a range, by which files are dealt to tasks.
RANGE_BYTES = 64 << 20
RANGES = "path string, i bigint, a bigint, b bigint, s bigint, e bigint"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (path, i, a, b, s) to the same with s, guessed where it is null, and e, where reading from s stops."""
    from pyarrow import fs

    for batch in batches:
        starts, ends = [], []
        for path, i, a, b, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            files, own = fs.FileSystem.from_uri(path)
            with files.open_input_file(own) as raw:
                source, ended = io.BufferedReader(raw, 1 << 20), []
                s = s if s is not None else 0 if i == 0 else guess(source, a, b)
                if s is not None and s < b:
                    for _ in records(source, s, b, ended):
                        pass
                starts.append(s)
                ends.append(ended[0] if ended else s)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["path", "i", "a", "b", "s", "e"])


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files (path, length) to ranges RANGES: each holds the records that begin in [s, e) of its file."""
    n = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1)).cast("long")
    cells = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    cells = cells.select("path", "i", (F.col("i") * range_bytes).alias("a"), F.least((F.col("i") + 1) * range_bytes, F.col("length")).alias("b"), F.lit(None).cast("bigint").alias("s"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(cells.repartition(parts, "path", "i").mapInArrow(_scanned, RANGES))
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a file
    while True:
        # where the ranges before stopped, if that is known to reach this one
        told = found.withColumn("from", F.when(F.col("i") == 0, 0).otherwise(F.max("e").over(before))).withColumn("from", F.when(F.col("from") >= F.col("a"), F.col("from")))
        wrong = (F.col("from").isNotNull()) & ~F.col("from").eqNullSafe(F.col("s")) | F.col("from").isNull()
        marked = cut(told.withColumn("wrong", wrong))
        if not marked.where("wrong").limit(1).count():
            return found
        again = marked.where("wrong AND `from` IS NOT NULL").select("path", "i", "a", "b", F.col("from").alias("s"))
        kept = marked.where("NOT wrong").select("path", "i", "a", "b", "s", "e")
        waits = marked.where("wrong AND `from` IS NULL").select("path", "i", "a", "b", F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("e"))
        found = cut(again.repartition(parts, "path", "i").mapInArrow(_scanned, RANGES).unionByName(kept).unionByName(waits))


def read_journal(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of export files: line, file (the app), timestamp (seconds, null if the record has none). Records without MESSAGE are left out.

    A task reads ranges of files and holds a record at a time. Values that aren't UTF-8 have U+FFFD for what isn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for uri, start, stop in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                files, own = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with files.open_input_file(own) as raw:
                    for r in records(io.BufferedReader(raw, 1 << 20), start, stop):
                        rows.append([(k, v.decode("utf-8", "replace")) for k, v in r.items()])
                        held += sum(map(len, r.values()))
                        if len(rows) == 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["record"])
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["record"])

    files = spark.read.format("binaryFile").load(path).select(file_uri(F.col("path")).alias("path"), "length")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = ranges(files, range_bytes).where("s < e").select("path", "s", "b").repartition(parts, "path", "s")
    found = own.mapInArrow(run, "record map<string,string>")
    r = F.col("record")
    seconds = F.element_at(r, "__REALTIME_TIMESTAMP").try_cast("long") / 1000000
    return found.where(F.element_at(r, "MESSAGE").isNotNull()).select(F.element_at(r, "MESSAGE").alias("line"), journal_app(r).alias("file"), F.floor(seconds).alias("timestamp"))
