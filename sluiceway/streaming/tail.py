"""A streaming source that tails growing text files by what of them is unread.

What was read of a file is a set of byte ranges by inode, so a renamed file goes on where it was. A trigger reads gaps between these
ranges, the first one of a file first, and what follows the last range up to a line end; a last line without an end waits. When a file ends
before its first gap it was truncated and starts anew: small ones from 0, others at their end. A file that isn't listed is forgotten after ``forgetAfterSeconds``,
as its inode may become another's.

A new file starts as the lookback says, or with the ranges that a sink has saved for its inode (option ``saved``, the folder
``offsets`` in the sink's state). Lines that are to be read again come as requests in a folder (option ``retries``, see ``ask_again``): once one is due, its ranges are
gaps again, and the lines come back with the number of their tries.

A trigger takes ``maxBytesPerTrigger``, dealt evenly over the files that have something unread, or, where one line is longer, that
line. Each trigger's offset states its ranges, so a micro-batch that runs again reads the same. Spark doesn't tell a source that goes
on from a checkpoint where it stood before it asks for the next end; with the option ``state``, a folder that outlives the query,
the source keeps what it planned last, and the limit holds from the first trigger on. The folder belongs to one checkpoint. Without it
a query's first trigger takes all that is there, each time it is started.

The driver lists files and looks for line ends; executors read the ranges, in pieces of ``maxBytesPerTask``.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sluiceway.sources.files import files_in, filesystem, json_lines, remove, write_whole

SMALL_FILE = 8192
TAIL_BYTES = 65536
#: Lines of about this many bytes go to Spark at once.
BATCH_BYTES = 1 << 20
SCHEMA = "line string, file string, file_id bigint, start bigint, end bigint, tries int"

Spans = list[list[int]]


class Range(InputPartition):
    def __init__(self, path: str, inode: int, start: int, end: int, tries: int = 0):
        super().__init__(None)
        self.path, self.inode, self.start, self.end, self.tries = path, inode, start, end, tries


def _files(root: str, pattern: str) -> dict[int, tuple[str, int, float]]:
    """inode to (first path in order, size, time of creation or change) of files that exist now."""
    found: dict[int, tuple[str, int, float]] = {}
    for folder, dirs, names in os.walk(root, followlinks=True):
        dirs.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            try:
                s = os.stat(path)
            except OSError:
                continue
            if fnmatch.fnmatch(path, pattern) and s.st_ino not in found:
                found[s.st_ino] = (path, s.st_size, s.st_ctime)
    return found


def _whole(path: str, start: int, size: int) -> int:
    """The place behind the last line end in [start, size), or start."""
    try:
        with open(path, "rb") as f:
            at = size
            while at > start:
                low = max(start, at - TAIL_BYTES)
                f.seek(low)
                hit = f.read(at - low).rfind(b"\n")
                if hit >= 0:
                    return low + hit + 1
                at = low
    except OSError:
        pass
    return start


def _next(path: str, start: int, size: int) -> int:
    """The place behind the first line end in [start, size), or start."""
    try:
        with open(path, "rb") as f:
            f.seek(start)
            at = start
            while at < size:
                piece = f.read(min(TAIL_BYTES, size - at))
                if not piece:
                    break
                hit = piece.find(b"\n")
                if hit >= 0:
                    return at + hit + 1
                at += len(piece)
    except OSError:
        pass
    return start


def union(spans: Spans) -> Spans:
    """The fewest half-open ranges that cover the same places, in order."""
    out: Spans = []
    for s, e in sorted([s, e] for s, e in spans if s < e):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def without(spans: Spans, gone: Spans) -> Spans:
    """What of ``spans`` is in none of ``gone``; both as ``union`` gives them."""
    out, k = [], 0
    for s, e in spans:
        while k and gone[k - 1][1] > s:
            k -= 1
        while k < len(gone) and gone[k][0] < e:
            if gone[k][1] > s:
                if gone[k][0] > s:
                    out.append([s, gone[k][0]])
                s = gone[k][1]
            k += 1
        if s < e:
            out.append([s, e])
    return out


def gaps(spans: Spans, size: int) -> list[tuple[int, int, bool]]:
    """What of [0, size) is unread: (start, end, whether a range follows)."""
    ends = [0, *[e for _, e in spans]]
    starts = [*[s for s, _ in spans], None]
    return [(a, size if z is None else min(z, size), z is not None) for a, z in zip(ends, starts, strict=True) if a < size and (z is None or a < z)]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.pattern = options.get("include", "*.log")
        self.lookback = options.get("lookback", "none").lower()
        self.began = float(options.get("startedAt", options.get("startedat", time.time())))
        self.saved, self.state, self.retries = options.get("saved"), options.get("state"), options.get("retries")
        self.per_trigger = int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 1 << 30)))
        self.per_task = int(options.get("maxbytespertask", options.get("maxBytesPerTask", 64 << 20)))
        self.forget_after = float(options.get("forgetafterseconds", options.get("forgetAfterSeconds", 60)))
        self.gone: dict[str, float] = {}  # since when files aren't listed
        self.first: dict | None = None
        self.now: dict | None = None  # the offset that was given last; unknown after a restart

    # -- offsets: {"files": inode to ranges read, "reads": inode to ranges of this trigger with their tries, "taken": requests opened in it, "n"}

    @staticmethod
    def _out(offset: dict) -> dict:
        return {"tail": json.dumps(offset, sort_keys=True)}

    def _new_file(self, path: str, size: int, created: float) -> Spans:
        old = self.lookback == "none" or self.lookback == "smallfiles" and size >= SMALL_FILE or self.lookback == "tail" and created <= self.began
        return union([[0, _whole(path, 0, size)]]) if old else []

    def initialOffset(self) -> dict:
        self.first = self.first or self._begin()
        self.now = self.now or self.first
        return self._out(self.first)

    def _begin(self) -> dict:
        saved: dict[int, Spans] = {}
        for row in json_lines(self.saved, ".json") if self.saved else ():
            saved.setdefault(row["file_id"], []).append([row["start"], row["end"] + 1])
        files = {}
        for inode, (path, size, created) in _files(self.root, self.pattern).items():
            spans = union(saved.get(inode, []))
            if len(spans) == 1:  # a single range was read from the start on
                spans[0][0] = 0
            files[str(inode)] = spans if spans and spans[0][1] <= size else self._new_file(path, size, created)
        return {"files": files, "reads": {}, "taken": [], "n": 0}

    def _keep(self, offset: dict) -> None:
        if not self.state:
            return
        write_whole(self.state, "planned.json", json.dumps(offset).encode())

    def _kept(self) -> dict | None:
        files, root = filesystem(self.state)
        try:
            with files.open_input_stream(f"{root}/planned.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _requests(self, taken: list[str]) -> tuple[list[str], dict[str, list]]:
        """Requests that are due and weren't opened yet: their names, and inode to (start, end, tries)."""
        names, wanted = [], {}
        if not self.retries:
            return names, wanted
        files, _ = filesystem(self.retries)
        for info in files_in(self.retries, ".again"):
            due = info.base_name.partition("_")[0]
            if not due.isdigit() or int(due) > time.time() * 1000 or info.base_name in taken:
                continue
            names.append(info.base_name)
            with files.open_input_stream(info.path) as f:
                for line in f.read().splitlines():
                    row = json.loads(line)
                    wanted.setdefault(str(row["file_id"]), []).append((row["start"], row["end"], row["tries"]))
        return names, wanted

    def latestOffset(self) -> dict:
        listed = _files(self.root, self.pattern)
        if self.now is None and self.state:  # Spark asks for the end of a new query's first trigger before its beginning
            self.first = self.now = self._kept() or self._begin()
        if self.now is None:
            return self._out({"files": {str(i): union([[0, _whole(path, 0, size)]]) for i, (path, size, _) in listed.items()}, "reads": None, "taken": [], "n": 0})
        names, wanted = self._requests(self.now["taken"])
        files, reads, todo = {}, {}, []
        for inode, (path, size, created) in sorted(listed.items()):
            known = self.now["files"].get(str(inode))
            spans = known if known is not None else []  # a file that comes while the query runs is read from its start
            open_ = gaps(spans, 1 << 62)
            if open_ and open_[0][0] > size:  # truncated
                spans = [] if size < SMALL_FILE else [[0, size]]
            again = [(s, min(e, size), t) for s, e, t in wanted.get(str(inode), []) if s < size]
            reads[str(inode)] = [[s, e, t] for s, e, t in again]
            files[str(inode)] = spans
            unread = without([[a, z] for a, z, _ in gaps(spans, size)], union([[s, e] for s, e, _ in again]))
            closed = {z for _, z, follows in gaps(spans, size) if follows}
            if unread:
                todo.append((sum(z - a for a, z in unread), str(inode), path, size, [(a, z, z in closed or z < size) for a, z in unread]))
        left = self.per_trigger - sum(e - s for r in reads.values() for s, e, _ in r)
        for k, (_, inode, path, size, unread) in enumerate(sorted(todo)):
            share = max(0, left) // (len(todo) - k)  # what small files don't need goes to larger ones
            for a, z, closed in unread:
                end = z if closed and z - a <= share else _whole(path, a, min(z, a + share))
                if end == a and left == self.per_trigger:  # a line longer than all that a trigger takes
                    end = _next(path, a, z)
                    end = z if closed and end == a else end
                if end > a:
                    reads[inode].append([a, end, 0])
                left, share = left - (end - a), share - (end - a)
                if end < z:
                    break
        clock = time.time()
        for inode, spans in self.now["files"].items():  # a file that is being renamed may be missed for a moment
            if inode not in files and clock - self.gone.setdefault(inode, clock) < self.forget_after:
                files[inode] = spans
        self.gone = {i: t for i, t in self.gone.items() if int(i) not in listed}
        reads = {i: r for i, r in reads.items() if r}
        files = {i: union(spans + [[s, e] for s, e, _ in reads.get(i, [])]) for i, spans in files.items()}
        if reads or names:
            self.now = {"files": files, "reads": reads, "taken": names, "n": self.now["n"] + 1}
        return self._out(self.now)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["tail"]), json.loads(end["tail"])
        listed, out = _files(self.root, self.pattern), []
        if before == after:
            return out
        reads = after["reads"]
        if reads is None:  # the source didn't know where it stood: all that the start hasn't read
            reads = {}
            for inode, spans in after["files"].items():
                read, (_, size, _) = before["files"].get(inode, []), listed.get(int(inode), ("", 0, 0))
                reads[inode] = [[a, z, 0] for a, z, _ in gaps([] if read and read[-1][1] > size else read, spans[-1][1] if spans else 0)]
        self.now = after
        self._keep(after)
        self._forget(before["taken"])
        for inode, ranges in reads.items():
            if int(inode) not in listed:
                continue
            path = listed[int(inode)][0]
            for at, stop, tries in ranges:
                while at < stop:
                    cut = stop if stop - at <= self.per_task else _whole(path, at, at + self.per_task)
                    cut = stop if cut == at else cut
                    out.append(Range(path, int(inode), at, cut, tries))
                    at = cut
        return out

    def _forget(self, names: list[str]) -> None:
        """Deletes requests whose lines were read by a micro-batch that is done."""
        for name in names:
            remove(self.retries, name)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at, lines, ends, held = partition.start, [], [partition.start], 0

            def batch() -> pa.RecordBatch:
                n = len(lines)
                columns = [pa.array(lines, pa.string()), pa.array([partition.path] * n, pa.string()), pa.array([partition.inode] * n, pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(ends[1:], pa.int64()), pa.array([partition.tries] * n, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, ["line", "file", "file_id", "start", "end", "tries"])

            while at < partition.end:
                raw = f.readline(partition.end - at)
                if not raw:
                    break
                at += len(raw)
                lines.append(raw.removesuffix(b"\n").decode("utf-8", "replace"))
                ends.append(at)
                held += len(raw)
                if held >= BATCH_BYTES:
                    yield batch()
                    lines, ends, held = [], [at], 0
            if lines:
                yield batch()

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``, then ``spark.readStream.format("tail").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


#: Times of tries are rounded down to this, so that lines that fail together come back together.
BUCKET_MS = 250


def ask_again(lines: DataFrame, folder: str, delay_ms: int = 5000, most: int = 5, now_ms: int | None = None) -> DataFrame:
    """Asks the tailing source for lines (file_id, start, end, tries) again: the try after n tries is due n + 1 delays later, in steps of BUCKET_MS.

    Tasks write one request file for each time and file of theirs; what comes back are the lines that had ``most`` tries, which go on as they are.
    For ``foreachBatch``, whose micro-batch the caller holds; one that runs again asks again, which reads the lines twice.
    """
    now = int(time.time() * 1000) if now_ms is None else now_ms
    due = F.floor((F.lit(now) + (F.col("tries") + 1) * delay_ms) / BUCKET_MS) * BUCKET_MS
    wanted = lines.where(F.col("tries") < most).select(due.cast("long").alias("due"), "file_id", "start", "end", (F.col("tries") + 1).alias("tries"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        part, n = f"{root}/{uuid.uuid4().hex}.part", 0
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for at, group in groupby(rows, lambda row: row[0]):
            said = hashlib.md5(usedforsecurity=False)
            with files.open_output_stream(part) as out:
                for _, *span in group:
                    line = (json.dumps(dict(zip(("file_id", "start", "end", "tries"), span, strict=True))) + "\n").encode()
                    said.update(line)
                    out.write(line)
                    n += 1
            files.move(part, f"{root}/{at}_{said.hexdigest()}.again")  # a task that runs again writes the same files
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    wanted.sortWithinPartitions("due", "file_id", "start").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return lines.where(F.col("tries") >= most)
