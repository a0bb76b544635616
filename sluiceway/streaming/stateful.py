"""Stateful processors: exact batches by size and time, and the high-water filter for late events.

They need the RocksDB state store: ``use_rocksdb(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluiceway.operators.events import mark_step


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SizeTimeBatcher(StatefulProcessor):
    """A batch closes when its bytes reach the capacity, with the line that does so, or when its timer ends."""

    def __init__(self, capacity: int, flush_ms: int):
        self.capacity, self.flush_ms = capacity, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "batch bigint, bytes bigint")
        self.lines = handle.getListState("lines", "line string, start bigint, end bigint")

    def _close(self, key: tuple, batch: int) -> pd.DataFrame:
        rows = list(self.lines.get())
        self.lines.clear()
        return pd.DataFrame({"file_id": [key[0]], "batch_id": [batch], "lines": [[r[0] for r in rows]], "start": [min(r[1] for r in rows)], "end": [max(r[2] for r in rows)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, used = tuple(self.head.get()) if self.head.exists() else (0, 0)
        for frame in rows:
            for line, start, end in frame.sort_values("start")[["line", "start", "end"]].itertuples(index=False):
                if not used:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)
                self.lines.appendValue((line, int(start), int(end)))
                used += len(line.encode()) + 1
                if used >= self.capacity:
                    yield self._close(key, batch)
                    batch, used = batch + 1, 0
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
        self.head.update((batch, used))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch, used = tuple(self.head.get()) if self.head.exists() else (0, 0)
        if used:
            self.head.update((batch + 1, 0))
            yield self._close(key, batch)

    def close(self) -> None:
        pass


def exact_batches(lines: DataFrame, capacity: int, flush_ms: int) -> DataFrame:
    """Lines (file_id, line, start, end) to batches (file_id, batch_id, lines, start, end)."""
    return lines.groupBy("file_id").transformWithStateInPandas(SizeTimeBatcher(capacity, flush_ms), "file_id bigint, batch_id bigint, lines array<string>, start bigint, end bigint", "Append", "ProcessingTime")


class HighWater(StatefulProcessor):
    """Keeps the events that ``operators.events.high_water`` keeps: the state is the mark."""

    def __init__(self, slack_us: int):
        self.slack = slack_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        for frame in rows:
            frame = frame.sort_values("seq")
            kept = []
            for t in frame["t"]:
                mark, ok = mark_step(mark, None if pd.isna(t) else int(t), None, self.slack)
                kept.append(ok)
            yield frame[kept][["key", "seq", "t"]]
        if mark is not None:
            self.mark.update((mark,))

    def close(self) -> None:
        pass


def high_water_stream(events: DataFrame, key: str, seq: str, ts: str, slack_seconds: int = 2) -> DataFrame:
    rows = events.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.unix_micros(ts).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(HighWater(slack_seconds * 1_000_000), f"key {kind}, seq bigint, t bigint", "Append", "None")


class PodRelease(StatefulProcessor):
    """Lets a deleted pod go once none of its files is open: the state is what is known of one pod."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "deleted boolean, open bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        deleted, files = tuple(self.known.get()) if self.known.exists() else (False, 0)
        for frame in rows:
            for kind in frame.sort_values("seq")["kind"]:
                if kind == "open":
                    files += 1
                elif kind == "close":
                    files = max(0, files - 1)
                else:
                    deleted = kind == "delete"
        if deleted and not files:
            self.known.clear()
            yield pd.DataFrame({"namespace": [key[0]], "pod": [key[1]]})
        else:
            self.known.update((deleted, files))

    def close(self) -> None:
        pass


def pod_release_stream(events: DataFrame) -> DataFrame:
    """Events (namespace, pod, seq, kind: create, delete, open, close) to the pods (namespace, pod) that may be forgotten now."""
    rows = events.select("namespace", "pod", "seq", "kind")
    return rows.groupBy("namespace", "pod").transformWithStateInPandas(PodRelease(), "namespace string, pod string", "Append", "None")


class LineRetries(StatefulProcessor):
    """Holds lines of a file whose metadata isn't known yet, and lets them go again later: the state is the file's waiting lines.

    A line that isn't ready is tried again after the delay times its tries so far (once at least), in whole seconds;
    after ``tries`` of them it is sent as it is. What comes back ready is sent, and waits no more.
    """

    def __init__(self, tries: int, delay_ms: int):
        self.tries, self.delay_ms = tries, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start bigint, end bigint", "line string, tries int, due bigint")

    def _row(self, key: tuple, span: tuple, line: str, tries: int, outcome: str) -> dict:
        return {"file_id": key[0], "start": int(span[0]), "end": int(span[1]), "line": line, "tries": tries, "outcome": outcome}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for start, end, line, ready in frame.sort_values("start")[["start", "end", "line", "ready"]].itertuples(index=False):
                span = (int(start), int(end))
                tries = self.waiting.getValue(span)[1] if self.waiting.containsKey(span) else 0
                if ready or tries >= self.tries:
                    if tries:
                        self.waiting.removeKey(span)
                    out.append(self._row(key, span, line, tries, "sent" if ready else "sent_as_is"))
                    continue
                due = max((now + self.delay_ms * max(1, tries)) // 1000 * 1000, now + 1)
                self.waiting.updateValue(span, (line, tries + 1, due))
                self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        out = [self._row(key, span, line, tries, "retry") for span, (line, tries, due) in ((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if due == now]
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def line_retries(lines: DataFrame, tries: int = 5, delay_ms: int = 5000) -> DataFrame:
    """Lines (file_id, start, end, line, ready) to rows with tries and outcome: sent, sent_as_is, or retry for those to be looked up and handed in again."""
    schema = "file_id bigint, start bigint, end bigint, line string, tries int, outcome string"
    rows = lines.select("file_id", "start", "end", "line", "ready")
    return rows.groupBy("file_id").transformWithStateInPandas(LineRetries(tries, delay_ms), schema, "Append", "ProcessingTime")
