"""Batches of lines, delivery outcomes and the retry folder's quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators import chains
from sluiceway.operators.folds import fold

CAPACITY = 2 * 1024 * 1024
FLUSH_SECONDS = 5.0


def assign_batches(lines: DataFrame, stream: str, order: str, size: str, capacity: int = CAPACITY, ts: str | None = None, flush_seconds: float = FLUSH_SECONDS) -> DataFrame:
    """Adds ``batch_id`` (from 0 in each stream): a batch closes once its sizes reach the capacity, the line that
    reaches it included, or, with ``ts``, when a line comes later than ``flush_seconds`` after the batch's first.

    Where a batch ends depends on all lines before it in the stream, so each stream is one fold over its
    lines in order; streams are folded in parallel, and a task holds one state, not a stream. A null size adds nothing.
    """
    when = F.unix_micros(ts) if ts else F.lit(0).cast("long")
    late = int(flush_seconds * 1e6)

    def step(state: tuple, s: int | None, t: int | None) -> tuple[tuple, int]:
        batch, held, began = state
        new = held >= capacity or (held > 0 and t is not None and began is not None and t - began > late)
        if new:
            batch, held = batch + 1, 0
        if held == 0:
            began = t
        return (batch, held + (s or 0), began), batch

    size_ = F.col(size).cast("long")
    return fold(lines, F.col(stream), [F.col(order), size_, when], [size_, when], (0, 0, None), step, "batch_id", "bigint")


def assign_batches_in_parts(lines: DataFrame, stream: str, order: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``assign_batches`` by size alone, for streams that hold too many lines for one task: a stream is many parts (see ``chains``).

    A batch that begins at a line ends with the first one at which the sizes since reach the capacity. A null size adds nothing; no size is below 0, and no two lines of a stream have the same place."""
    rows = chains.placed(lines, F.col(stream), [F.col(order)], F.coalesce(F.col(size), F.lit(0)))
    pointers = chains.next_starts(rows, F.col("total"), F.col("total") - F.col("size") + capacity, strict=False, step=1)
    last = rows.groupBy("k").agg(F.max("place").alias("last"))
    pointers = pointers.join(last, "k").select("k", "place", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next"))
    return chains.with_batches(rows, chains.chained(pointers), lines.columns, batch_id=F.col("batch"))


def bodies(batched: DataFrame, stream: str, order: str) -> DataFrame:
    """One request body for each batch: {"lines": [...]} in order, without null fields."""
    own = [c for c in batched.columns if c not in (stream, "batch_id")]
    line = F.struct(*[F.col(c) for c in own])
    grouped = batched.groupBy(stream, "batch_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    return grouped.select(stream, "batch_id", F.to_json(F.struct(F.transform("rows", lambda r: r["line"]).alias("lines"))).alias("body"))


#: Answers after which a batch is sent again later.
RETRY_STATUSES = (429, 500, 501, 502, 503, 504, 507)


def outcome(status: Column, timed_out: Column | None = None) -> Column:
    """delivered, retry (also after a timeout or without an answer) or fatal."""
    late = F.coalesce(timed_out, F.lit(False)) if timed_out is not None else F.lit(False)
    return F.when(late | status.isNull() | status.isin(*RETRY_STATUSES), "retry").when(status == 200, "delivered").otherwise("fatal")


def within_quota(files: DataFrame, limit: int, group: str | None, order: str = "name", size: str = "bytes", used: int = 0) -> DataFrame:
    """Retry files in order of arrival with ``used`` (what is stored once the file was dealt with) and ``kept``.

    A file that would lead beyond the limit is dropped and counts for nothing, so a smaller one behind it may still fit. ``used`` bytes are stored before the first.
    What fits depends on all files before, so it is a fold for each group; a null size counts for nothing.
    """

    def step(held: int, n: int | None) -> tuple[int, int]:
        needed = held + (n or 0)
        return (needed, needed) if needed <= limit else (held, -1 - held)

    n = F.col(size).cast("long")
    folded = fold(files, F.col(group) if group else F.lit(0), [F.col(order), n], [n], used, step, "__held", "bigint")
    kept = F.col("__held") >= 0
    return folded.withColumn("used", F.when(kept, F.col("__held")).otherwise(-1 - F.col("__held"))).withColumn("kept", kept).drop("__held")


def retry_time(now_ms: Column, delay_ms: Column, tries: Column) -> Column:
    """When a line is tried again: delay times tries later, in whole seconds."""
    return F.floor((now_ms + delay_ms * tries) / 1000) * 1000


def backoff_ms(n: Column, base: int = 10) -> Column:
    return F.pow(F.lit(2), n).cast("long") * base
