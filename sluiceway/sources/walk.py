"""Listing a tree of directories by tasks: level by level, rules before descent, each directory once.

The frontier is a table of directories. Tasks list them, each row as it is met; the directories among what they found are the next
frontier, but those that the rules exclude as a whole and those that were listed before, by whatever path or symbolic link.
A directory is known by its device and inode where the file system has them (its path elsewhere), so cycles of links end. The
driver counts; it lists nothing. Each level is written.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.lineage import cut
from sluiceway.operators.rules import PathRules
from sluiceway.sources.files import filesystem

ENTRIES = "path string, kind string, link_target string, inode bigint, size bigint, modified timestamp, id string"
BATCH = 4096


def _local(folder: str) -> Iterator[tuple]:
    try:
        found = os.scandir(folder)
    except OSError:  # gone, or not ours to read
        return
    with found:
        for e in found:
            try:
                s = e.stat()  # of what a link points to
            except OSError:
                continue
            kind = "dir" if e.is_dir() else "file"
            yield (e.path, kind, os.path.realpath(e.path) if e.is_symlink() else None, s.st_ino, None if kind == "dir" else s.st_size, int(s.st_mtime * 1e6), f"{s.st_dev}:{s.st_ino}")


def _remote(folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    files, root = filesystem(folder)
    scheme = folder[: len(folder) - len(root)]
    for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        kind = "dir" if i.type == fs.FileType.Directory else "file"
        yield (scheme + i.path, kind, None, None, i.size, i.mtime_ns // 1000 if i.mtime_ns else None, scheme + i.path)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
    names = ["path", "kind", "link_target", "inode", "size", "modified", "id"]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    for b in batches:
        for folder in b.column(0).to_pylist():
            for row in _remote(folder) if ":/" in folder else _local(folder):
                held.append(row)
                if len(held) >= BATCH:
                    yield batch()
                    held = []
    yield batch()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots that are there, with their ids."""
    for b in batches:
        out = []
        for path in b.column(0).to_pylist():
            try:
                s = None if ":/" in path else os.stat(path)
                out.append((path, path if s is None else f"{s.st_dev}:{s.st_ino}"))
            except OSError:
                continue
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["path", "id"])


def walk(spark: SparkSession, roots: list[str], rules: PathRules | None = None) -> DataFrame:
    """Entries below the roots: path, kind (dir or file, of what a link points to), link_target (a link's, resolved), inode, size, modified.

    ``roots`` are paths that all executors see, or URIs. With rules, directories that they exclude as a whole are entries but aren't entered, and of files those
    that pass are entries. A directory that can be reached by several paths is entered by the least path of the first level that reaches it. A root that isn't there holds nothing.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = spark.createDataFrame([(r if ":/" in r else os.path.abspath(r),) for r in roots], "path string")
    frontier = cut(given.mapInArrow(_roots, "path string, id string").groupBy("id").agg(F.min("path").alias("path")).select("path", "id"))
    levels, seen = [], frontier.select("id")
    while True:
        found = cut(frontier.select("path").repartition(parts, "path").mapInArrow(_listed, ENTRIES))
        levels.append(found if rules is None else found.where((F.col("kind") == "dir") | rules.passes(F.col("path"))))
        down = found.where("kind = 'dir'")
        if rules is not None:
            down = down.where(~rules.excludes_all(F.col("path")))
        frontier = down.groupBy("id").agg(F.min("path").alias("path")).select("path", "id")
        frontier = cut(frontier.join(seen, "id", "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier.select("id"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.drop("id")


#: Bytes of a file that one task reads at a time.
RANGE_BYTES = 64 << 20
LINES = "line string, file string, file_id bigint, start bigint, end bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (path, inode, a, b) of files to the lines that begin in them; a line that goes on behind its range is read whole."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for path, inode, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            files, own = filesystem(path)
            held, size = [], 0
            with files.open_input_file(own) as raw:
                source = io.BufferedReader(raw, 1 << 20)
                source.seek(max(0, a - 1))
                if a:  # the range before reads the line that stands across the border
                    source.readline()
                at = source.tell()
                while at < b and (line := source.readline()):
                    held.append((line.removesuffix(b"\n").decode("utf-8", "replace"), path, inode, at, at + len(line)))
                    at, size = at + len(line), size + len(line)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["line", "file", "file_id", "start", "end"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["line", "file", "file_id", "start", "end"])


def read_tree(spark: SparkSession, roots: list[str], rules: PathRules | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of all files that ``walk`` finds: line (ended by \\n only; invalid UTF-8 becomes U+FFFD), file, file_id (its inode), and the bytes [start, end) where it stands.

    A large file is many tasks. A file with several paths is read by each."""
    found = walk(spark, roots, rules).where("kind = 'file' AND size > 0")
    n = F.ceil(F.col("size") / range_bytes).cast("long")
    ranges = found.select("path", F.col("inode").alias("inode"), "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("path", "inode", (F.col("i") * range_bytes).alias("a"), F.least((F.col("i") + 1) * range_bytes, F.col("size")).alias("b")).repartition(parts, "path", "a")
    return dealt.mapInArrow(_read, LINES)


def changes(spark: SparkSession, roots: list[str], state: str, rules: PathRules | None = None) -> DataFrame:
    """Lists the roots and tells what is different from the last time: events as ``events.tree_events`` gives them; all are creates the first time.

    Each listing is kept as a table below ``state``, numbered, and is the one before of the next call; one that wasn't written whole isn't taken. Symbolic links are
    no paths of an inode here, so what they point to counts where it stands.
    """
    from pyarrow import fs

    from sluiceway.operators.events import tree_events

    files, root = filesystem(state)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    whole = sorted(i.base_name for i in found if i.base_name.startswith("listing-") and files.get_file_info(f"{i.path}/_SUCCESS").type == fs.FileType.File)
    number = 1 + max((int(i.base_name.partition("-")[2]) for i in found if i.base_name.startswith("listing-")), default=0)
    uri = state if ":/" in state else f"file://{os.path.abspath(state)}"
    now = walk(spark, roots, rules).where("link_target IS NULL").select("path", "inode", "size", "kind")
    now.write.parquet(f"{uri}/listing-{number:09d}")
    now = spark.read.schema(now.schema).parquet(f"{uri}/listing-{number:09d}")
    before = spark.read.schema(now.schema).parquet(f"{uri}/{whole[-1]}") if whole else now.where("false")
    return tree_events(before, now)
