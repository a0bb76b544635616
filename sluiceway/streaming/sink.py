"""Delivery of lines in batches: post, classify, keep what failed with its offsets, and commit offsets after success.

``spark.dataSource.register(BatchSink)``, then ``lines.writeStream.format("batches").options(url=..., retries=..., state=...)``.

Each task makes batches of its lines, file by file, as they come (the tailing source gives a task consecutive lines of one file), and posts them, several at a
time. A body's key is a digest of its lines and their places, so a micro-batch that runs again makes the same bodies under the same keys: they are
sent as ``Idempotency-Key``, and what was done with a body is written under its key at once.

- A delivered body leaves a mark; a task that runs again doesn't post it again.
- A body that may be sent again is staged; the commit gives it its final name in the retry folder, within the quota, and until
  then no replay sees it. A task that runs again finds it staged and leaves it.
- A fatal answer fails the task once all its bodies had their answers. The micro-batch can be run again: what was delivered or staged stays so.
- The ranges of delivered and of staged bodies are staged, too, and committed with the micro-batch below ``state/offsets``, from where
  the tailing source (its option ``saved``) and ``saved_offsets`` read them.
- Marks, which stored bodies get, too, stay until the next micro-batch commits: a micro-batch that was committed here but not by Spark runs again and finds all done.

So a body is posted twice only if a task dies between an answer and its mark. What reaches the driver are names and sizes of
files, a few for each task and one for each body that failed.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from sluiceway.operators import batching
from sluiceway.operators.spans import coalesce_spans
from sluiceway.sources import files, retry

Post = Callable[[str, str], int | None]

#: Requests that one task has under way at a time.
CONCURRENT = 8
#: Open batches of one task, as multiples of the capacity; beyond it the fullest are closed.
OPEN_BATCHES = 8
#: Columns that say where a line stands; the others go into the body.
PLACE = ("file_id", "start", "end", "tries")


def http_post(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0, level: int = 2) -> Post:
    """A function that posts a body, compressed, under a key and returns the status; None for timeouts and broken connections."""

    def post(body: str, key: str) -> int | None:
        import gzip
        import urllib.error
        import urllib.request

        data = gzip.compress(body.encode(), level)
        request = urllib.request.Request(url, data, {"Content-Type": "application/json", "Content-Encoding": "gzip", "Idempotency-Key": key, **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.status
        except urllib.error.HTTPError as e:
            return e.code
        except OSError:
            return None

    return post


class DeliveryError(RuntimeError):
    """A body that will never be taken (a client error)."""


def backoff(failures: int) -> float:
    """Seconds to wait before the next request after so many failures in a row: 2^n times 10 ms, 10 s at most."""
    return min(10.0, 0.01 * 2**failures) if failures else 0.0


def verdict(status: int | None) -> str:
    """delivered, retry or fatal, as ``batching.outcome`` says."""
    if status is None or status in batching.RETRY_STATUSES:
        return "retry"
    return "delivered" if status == 200 else "fatal"


@dataclass
class Batch:
    """An open batch of one file's lines."""

    lines: list[dict] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, row: dict, size: int) -> None:
        start, end = row["start"], row["end"]
        if self.spans and self.spans[-1][1] == start:
            self.spans[-1] = (self.spans[-1][0], end)
        else:
            self.spans.append((start, end))
        self.lines.append({k: v for k, v in row.items() if k not in PLACE and v is not None})
        self.size += size


class BatchWriter(DataSourceStreamWriter):
    def __init__(self, options: dict, post: Post | None = None):
        get = {k.lower(): v for k, v in options.items()}.get
        self.retries, self.state = get("retries"), get("state")
        if not self.retries or not self.state:
            raise ValueError("the options retries and state name folders that tasks and driver share")
        self.capacity, self.concurrent = int(get("capacity", batching.CAPACITY)), int(get("concurrent", CONCURRENT))
        self.limit = int(get("limitbytes")) if get("limitbytes") else None
        self.failures = 0  # in a row, in this task
        self.post = post or http_post(get("url"), json.loads(get("headers", "{}")), float(get("timeout", 10)))

    # -- in the tasks

    def _bodies(self, rows: Iterator) -> Iterator[tuple[int, Batch]]:
        opened: dict[int, Batch] = {}
        held = 0
        for row in rows:
            row = row.asDict(recursive=True)
            batch = opened.setdefault(row["file_id"], Batch())
            size = len((row["line"] or "").encode()) + 1
            batch.add(row, size)
            held += size
            while opened and (batch.size >= self.capacity or held >= OPEN_BATCHES * self.capacity):
                name = row["file_id"] if batch.size >= self.capacity else max(opened, key=lambda k: opened[k].size)
                done = opened.pop(name)
                held -= done.size
                yield name, done
                batch = opened.get(row["file_id"], Batch())
        yield from opened.items()

    def _send(self, file_id: int, batch: Batch) -> tuple[str, str, int]:
        """Posts one body unless that was done before: its verdict, its key (the status if it is fatal), and the size of what was staged."""
        spans = [{"file_id": file_id, "start": s, "end": e - 1} for s, e in batch.spans]
        body, offsets = json.dumps({"lines": batch.lines}, ensure_ascii=False, separators=(",", ":")), json.dumps(spans)
        key = hashlib.sha256(f"{offsets}\n{body}".encode()).hexdigest()[:32]
        if files.size_of(f"{self.state}/delivered", key) is not None:
            return "delivered", key, 0
        if (size := files.size_of(f"{self.retries}/staged", key)) is not None:
            return "retry", key, size
        time.sleep(backoff(self.failures))
        status = self.post(body, key)
        said = verdict(status)
        self.failures = self.failures + 1 if said == "retry" else 0
        if said == "delivered":
            files.write_whole(f"{self.state}/delivered", key, b"")
        elif said == "retry":
            data = retry.packed(body, offsets)
            files.write_whole(f"{self.retries}/staged", key, data)
            return said, key, len(data)
        return said, key if said == "delivered" else str(status), 0

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        message = Sent()
        spans = hashlib.sha256()
        part = []
        fatal = None
        with ThreadPoolExecutor(self.concurrent) as pool:
            under_way: list[tuple[int, Batch, Future]] = []

            def settle(left: int) -> None:
                nonlocal fatal
                while len(under_way) > left:
                    file_id, batch, answer = under_way.pop(0)
                    said, name, size = answer.result()
                    if said == "fatal":
                        fatal = fatal or name
                        continue
                    if said == "retry":
                        message.staged.append((name, size))
                    else:
                        message.delivered.append(name)
                    for s, e in batch.spans:
                        line = json.dumps({"file_id": file_id, "start": s, "end": e - 1})
                        spans.update(line.encode())
                        part.append(line)

            for file_id, batch in self._bodies(iterator):
                under_way.append((file_id, batch, pool.submit(self._send, file_id, batch)))
                settle(self.concurrent - 1)
            settle(0)
        if part:
            message.offsets = f"{spans.hexdigest()[:32]}.json"
            files.write_whole(f"{self.state}/staged", message.offsets, ("\n".join(part) + "\n").encode())
        if fatal is not None:
            raise DeliveryError(f"status {fatal}")
        return message

    # -- on the driver

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        """Staged bodies get their names in the retry folder, as far as the quota allows, and ranges theirs. Each step can run again."""
        sent = [m for m in messages if m is not None]
        fs, root = files.filesystem(self.retries)
        waiting = {i.base_name for i in files.files_in(f"{self.retries}/staged", "")}
        bodies = sorted(b for m in sent for b in m.staged if b[0] in waiting)
        kept, dropped = retry.keep_within(bodies, self.limit, retry.stored_bytes(self.retries))
        for name in kept:
            files.write_whole(f"{self.state}/delivered", name, b"")
            fs.move(f"{root}/staged/{name}", f"{root}/{int(time.time())}_{name}{retry.ENDING}")
        for name in dropped:
            files.remove(f"{self.retries}/staged", name)
        fs, root = files.filesystem(self.state)
        fs.create_dir(f"{root}/offsets/batch={batchId}", recursive=True)
        for m in sent:
            if m.offsets and files.size_of(f"{self.state}/staged", m.offsets) is not None:
                fs.move(f"{root}/staged/{m.offsets}", f"{root}/offsets/batch={batchId}/{m.offsets}")
        if dropped:
            files.write_whole(f"{self.state}/dropped", f"{batchId}.json", json.dumps({"batch": batchId, "dropped": len(dropped)}).encode())
        done = {f"{batchId}.json": {key for m in sent for key in m.delivered} | set(kept)}
        for info in files.files_in(f"{self.state}/done", ".json"):
            done.setdefault(info.base_name, set()).update(row["key"] for row in files.json_lines(f"{self.state}/done", info.base_name))
        files.write_whole(f"{self.state}/done", f"{batchId}.json", "".join(json.dumps({"key": k}) + "\n" for k in sorted(done.pop(f"{batchId}.json"))).encode())
        for name, keys in done.items():
            for key in keys:
                files.remove(f"{self.state}/delivered", key)
            files.remove(f"{self.state}/done", name)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        """What tasks staged and marked stays for the run that comes; nothing of it was committed."""


@dataclass
class Sent(WriterCommitMessage):
    """What one task did: keys of delivered bodies, names and sizes of staged ones, the name of its staged ranges."""

    delivered: list[str] = field(default_factory=list)
    staged: list[tuple[str, int]] = field(default_factory=list)
    offsets: str | None = None


def admitted(lines: DataFrame, requests: int, concurrent: int = CONCURRENT) -> tuple[DataFrame, dict[str, str]]:
    """Lines and options of the sink for which no more than ``requests`` are under way at a time, in all tasks together: a task has its share of the limit, and there are
    no more tasks than shares. Tasks are coalesced, so the lines of a task stay in order."""
    own = max(1, min(concurrent, requests))
    return lines.coalesce(max(1, requests // own)), {"concurrent": str(own)}


class BatchSink(DataSource):
    """Options: url, headers (JSON), timeout, retries and state (folders), capacity (bytes), concurrent, limitBytes (of the retry folder)."""

    @classmethod
    def name(cls) -> str:
        return "batches"

    def streamWriter(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options))


def saved_offsets(spark: SparkSession, state: str) -> DataFrame:
    """What the sink has committed below ``state``, all micro-batches coalesced: rows (file_id, start, end), ends inclusive."""
    return coalesce_spans(spark.read.schema("file_id bigint, start bigint, end bigint").option("recursiveFileLookup", True).json(f"{state}/offsets"), "file_id")


def dropped_bodies(state: str) -> int:
    """Bodies that the quota dropped."""
    return sum(row["dropped"] for row in files.json_lines(f"{state}/dropped", ".json"))


def send_due(spark: SparkSession, folder: str, post: Post, now_epoch: int, base_delay: int) -> dict[str, int]:
    """Posts stored bodies that are due, from the tasks, and counts them by outcome.

    A delivered body's file is deleted; one that may be sent again is stored anew under the time of this try; one that will never be taken is set aside under the ending
    ``.rejected``. A task that runs again passes over files that are gone."""
    ready = retry.read_files(spark, folder, F.lit(now_epoch), base_delay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = files.filesystem(folder)

        def replay(name: str, body: str | None) -> str:
            if files.size_of(folder, name) is None:
                return "gone"
            epoch, _, key = name.removesuffix(retry.ENDING).partition("_")
            said = verdict(post(body, key)) if body is not None else "fatal"
            if said == "delivered":
                files.remove(folder, name)
            elif said == "retry":
                fs.move(f"{root}/{name}", f"{root}/{now_epoch}_{key}{retry.ENDING}")
            else:
                fs.move(f"{root}/{name}", f"{root}/{name}.rejected")
            return said

        with ThreadPoolExecutor(CONCURRENT) as pool:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(list(pool.map(replay, b.column(0).to_pylist(), b.column(1).to_pylist())), pa.string())], ["outcome"])

    counted = ready.select("name", "body").mapInArrow(run, "outcome string").groupBy("outcome").count().collect()
    return {r.outcome: r["count"] for r in counted}
