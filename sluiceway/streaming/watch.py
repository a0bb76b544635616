"""Watches as streams: debounced and delayed file events, and pods known from a watch, joined to the lines that name them.

State is kept by path or by pod, with timers in processing time. They need the RocksDB state store: ``stateful.use_rocksdb(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUEUED = ("create", "write", "remove", "rename")
EVENTS = "path string, seq bigint, kind string, ts timestamp, n bigint"


class Debouncer(StatefulProcessor):
    """Holds the events of a path and lets them go, in order, once the first has waited for the delay: the state is the queue of one path.

    A write that follows a write joins it and keeps the earlier time. A write that is resumed or asked for again stands in front, and joins a write there.
    What isn't an event of a file (an error, a rescan) isn't held. An event may have a delay of its own, in milliseconds.
    """

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "seq bigint, kind string, us bigint, n bigint, due bigint")

    def _out(self, path: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"path": [path] * len(rows), "seq": [r[0] for r in rows], "kind": [r[1] for r in rows], "ts": pd.to_datetime([r[2] for r in rows], unit="us"), "n": [r[3] for r in rows]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, now = [tuple(r) for r in self.queue.get()], timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for seq, kind, us, front, wait in frame.sort_values("seq")[["seq", "kind", "us", "front", "delay_ms"]].itertuples(index=False):
                due = now + int(self.delay_ms if pd.isna(wait) else wait)
                if kind not in QUEUED:
                    yield self._out(key[0], [(seq, kind, us, 1)])
                    continue
                at = 0 if front else len(held) - 1
                if held and kind == "write" and held[at][1] == "write":
                    known = held[at]
                    held[at] = (min(known[0], seq), "write", min(known[2], us), known[3] + 1, min(known[4], due))
                else:
                    held.insert(0 if front else len(held), (int(seq), kind, int(us), 1, due))
                    self.handle.registerTimer(due)
        if held:
            self.queue.put(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = [tuple(r) for r in self.queue.get()], expiredTimerInfo.getExpiryTimeInMs()
        ready = 0  # an event waits for those before it
        while ready < len(held) and held[ready][4] <= now:
            ready += 1
        if not ready:
            return
        left = held[ready:]
        if left:
            self.queue.put(left)
            self.handle.registerTimer(max(left[0][4], now + 1))
        else:
            self.queue.clear()
        yield self._out(key[0], held[:ready])

    def close(self) -> None:
        pass


def merged_events(*sources: DataFrame) -> DataFrame:
    """Streams of events (path, seq, kind, ts) as one, with ``front`` (resumed or asked for again) and ``delay_ms`` (an event's own delay), which are false and null where a source has none."""
    columns = {"front": F.lit(False), "delay_ms": F.lit(None).cast("bigint")}
    full = [s.withColumns({n: c for n, c in columns.items() if n not in s.columns}).select("path", "seq", "kind", "ts", "front", "delay_ms") for s in sources]
    out = full[0]
    for more in full[1:]:
        out = out.unionByName(more)
    return out


def debounced_stream(events: DataFrame, delay_ms: int = 250) -> DataFrame:
    """Events as ``merged_events`` gives them to rows (path, seq, kind, ts, n): n events as one, let go in order once they waited."""
    rows = events.select("path", F.col("seq").cast("long").alias("seq"), "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "front", "delay_ms")
    return rows.groupBy("path").transformWithStateInPandas(Debouncer(delay_ms), EVENTS, "Append", "ProcessingTime")


class PodWatch(StatefulProcessor):
    """What a watch last said of a pod, and lines that name it: the state is one pod's metadata, and lines that came before it.

    A line goes on with the metadata known when it comes. One of a pod that isn't known waits for it, for ``patience_ms`` at most, and goes on as it is then. A
    deleted pod is known to the lines of the same micro-batch and forgotten after; what is known of a pod that says nothing more ends with the state's time to live.
    """

    def __init__(self, patience_ms: int, ttl_ms: int):
        self.patience_ms, self.ttl_ms = patience_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "version bigint, meta string", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "seq bigint, line string, due bigint")

    def _out(self, key: tuple, lines: list[tuple], meta: str | None) -> pd.DataFrame:
        return pd.DataFrame({"namespace": [key[0]] * len(lines), "pod": [key[1]] * len(lines), "seq": [x[0] for x in lines], "line": [x[1] for x in lines], "meta": pd.Series([meta] * len(lines), dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, meta = tuple(self.known.get()) if self.known.exists() else (-1, None)
        lines, gone, now = [], False, timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            for kind, seq, text in frame[["kind", "seq", "text"]].itertuples(index=False):
                if kind == "line":
                    lines.append((int(seq), text, now + self.patience_ms))
                elif seq > version:  # the watch may say things twice
                    version, gone = int(seq), kind == "delete"
                    meta = meta if gone else text
        if meta is not None:
            lines = [tuple(x) for x in self.waiting.get()] + lines
            self.waiting.clear()
            if lines:
                yield self._out(key, sorted(lines), meta)
            if gone:
                self.known.clear()
            else:
                self.known.update((version, meta))
        else:
            for x in lines:
                self.waiting.appendValue(x)
            if lines:
                self.handle.registerTimer(lines[0][2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = expiredTimerInfo.getExpiryTimeInMs(), [tuple(x) for x in self.waiting.get()]
        late = [x for x in held if x[2] <= now]
        if late:
            self.waiting.clear()
            for x in held:
                if x[2] > now:
                    self.waiting.appendValue(x)
            yield self._out(key, sorted(late), None)

    def close(self) -> None:
        pass


def with_watched_pods(lines: DataFrame, watch: DataFrame, patience_ms: int = 5000, ttl_ms: int = 3_600_000) -> DataFrame:
    """Lines (namespace, pod, seq, line) with ``meta``, what the watch (namespace, pod, version, kind: apply or delete, meta) last said of their pod; null where it said nothing in time.

    Both are streams, dealt by pod; the lines of one pod are one task's."""
    said = watch.select("namespace", "pod", "kind", F.col("version").cast("long").alias("seq"), F.col("meta").alias("text"))
    both = said.unionByName(lines.select("namespace", "pod", F.lit("line").alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("line").alias("text")))
    return both.groupBy("namespace", "pod").transformWithStateInPandas(PodWatch(patience_ms, ttl_ms), "namespace string, pod string, seq bigint, line string, meta string", "Append", "ProcessingTime")
