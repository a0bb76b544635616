"""Running queries: chains of stages, supervision, and what a running query reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

Stage = Callable[[DataFrame], DataFrame]


def chain(lines: DataFrame, *stages: Stage | None) -> DataFrame:
    """The stages in order; None stands for one that has nothing to do."""
    for stage in stages:
        lines = lines if stage is None else lines.transform(stage)
    return lines


def skipped_by(stages: dict[str, Column | None]) -> Column:
    """The name of the first stage whose condition a line doesn't meet; null for lines that meet all. A condition that is null isn't met; None stands for a stage that has nothing to do."""
    tests = [F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in stages.items() if c is not None]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def supervise(start: Callable[[], StreamingQuery], restarts: int = 10, every_seconds: float | None = None, delay_seconds: float = 1.0, until: Callable[[], bool] | None = None) -> int:
    """Runs a query until it ends by itself or ``until`` says so; starts it anew from its checkpoint when it fails and, with
    ``every_seconds``, at intervals. Failures in a row are counted against ``restarts``, intervals are not. Returns how often it started anew."""
    failures = began = 0
    while True:
        query = start()
        began += 1
        try:
            if query.awaitTermination(every_seconds) or every_seconds is None:
                return began - 1
            query.stop()
            failures = 0
        except Exception:
            failures += 1
            if failures > restarts:
                raise
            time.sleep(delay_seconds * 2 ** (failures - 1))
        if until is not None and until():
            return began - 1


class Progress(StreamingQueryListener):
    """Rows and durations of micro-batches, as counters for export."""

    def __init__(self) -> None:
        self.batches = self.rows = 0
        self.seconds = 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.seconds += event.progress.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
