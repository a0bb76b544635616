"""Interval algebra over byte ranges: as rows (key, start, end) and as arrays of spans. Ends that touch (end + 1 = start) join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "array<struct<start:bigint,end:bigint>>"


#: Spans of one key that start in the same stretch of this many places are joined first.
STRETCH = 1 << 20
#: About as many spans as a task sorts; it takes some 250 MB for them.
TASK_ROWS = 500_000


def coalesce_spans(spans: DataFrame, key: str) -> DataFrame:
    """Rows to the fewest rows that cover the same ranges: a span starts an island if all earlier ends are more than one before it.

    Islands are made in each stretch of a key, then of these in the whole key: a key that holds most rows is many tasks until its rows are few.
    The rows are counted first, so that there are as many tasks as they need.
    """
    session = spans.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, -(-spans.count() // TASK_ROWS))
    kept = spans.select(key, "start", "end").where("start <= end").withColumn("__stretch", F.floor(F.col("start") / STRETCH))
    near = _islands(kept, [key, "__stretch"], tasks).drop("__stretch")
    return _islands(near, [key], tasks)


def _islands(spans: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > F.col("reach") + 1), 1).otherwise(0)).over(ordered)
    marked = spans.repartition(tasks, *keys).withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_array(spans: Column) -> Column:
    """The same for an array: for states of files, which have few spans."""

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"] + 1), grown).otherwise(F.concat(acc, F.array(s)))

    ordered = F.sort_array(F.filter(F.coalesce(spans, F.array().cast(EMPTY)).cast(EMPTY), lambda s: s["start"] <= s["end"]))
    return F.aggregate(ordered, F.array().cast(EMPTY), step)


def remove_span(spans: Column, start: Column, end: Column) -> Column:
    """Spans without a range. A span that holds the range keeps both edges; one cut on its right ends one before it; one cut on its left starts at its end."""

    def cut(s: Column) -> Column:
        part = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
        inside = (s["start"] < start) & (end > s["start"]) & (end < s["end"])
        covered = (s["start"] >= start) & (end >= s["end"]) & (end > s["start"])
        right = (s["start"] < start) & (start <= s["end"]) & (end >= s["end"])
        left = (s["start"] >= start) & (end > s["start"]) & (end < s["end"])
        none = F.array().cast(EMPTY)
        return F.when(inside, F.array(part(s["start"], start), part(end, s["end"]))).when(covered, none).when(right, F.array(part(s["start"], start - 1))).when(left, F.array(part(end, s["end"]))).otherwise(F.array(part(s["start"], s["end"])))

    return F.flatten(F.transform(spans, cut))


def first_gap(spans: Column) -> Column:
    """(start, end) of what is unread first: behind a first span that starts at 0, else before it; end is null where nothing follows."""
    gap = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    first, second, none = F.get(spans, F.lit(0)), F.get(spans, F.lit(1)), F.lit(None)
    return F.when(F.size(spans) <= 0, gap(F.lit(0), none)).when(first["start"] == 0, gap(first["end"], second["start"] - 1)).otherwise(gap(F.lit(0), first["start"] - 1))


def gaps(spans: DataFrame, key: str) -> DataFrame:
    """All gaps between coalesced rows of a key, the open one at the end included."""
    ordered = Window.partitionBy(key).orderBy("start")
    after = spans.withColumn("next", F.lead("start").over(ordered)).select(key, F.col("end").alias("start"), (F.col("next") - 1).alias("end"))
    before = spans.groupBy(key).agg(F.min("start").alias("m")).where("m > 0").select(key, F.lit(0).cast("long").alias("start"), (F.col("m") - 1).alias("end"))
    return after.unionByName(before)


def contains(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= start) & (s["end"] >= end))


def merge_offsets(offsets: DataFrame, batch: str = "batch_id", file: str = "file_id") -> DataFrame:
    """Per batch and file the coalesced spans: rows (batch, file, spans)."""
    keyed = offsets.withColumn("__k", F.struct(batch, file))
    merged = coalesce_spans(keyed.select("__k", "start", "end"), "__k")
    return merged.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).select("__k.*", "spans")


#: Bytes below which a file counts as small.
SMALL_FILE = 8192


def initial_spans(mode: Column, file_len: Column, created: Column, agent_start: Column, saved: Column) -> Column:
    """Where reading starts: read spans of a file when it is first met.

    Saved spans win unless the first ends behind the file's end; a single saved span is taken as
    read from 0. Modes: start (nothing read), none (all read), smallfiles (all read from 8192 bytes on), tail
    (nothing read if created after the start, else all).
    """
    none, whole = F.array().cast(EMPTY), F.array(F.struct(F.lit(0).cast("long").alias("start"), file_len.cast("long").alias("end")))
    m = F.lower(mode)
    default = F.when(m == "start", none).when(m == "smallfiles", F.when(file_len < SMALL_FILE, none).otherwise(whole)).when(m == "tail", F.when(created > agent_start, none).otherwise(whole)).otherwise(whole)
    one = F.get(saved, F.lit(0))
    kept = F.when(F.size(saved) == 1, F.array(F.struct(F.lit(0).cast("long").alias("start"), one["end"].cast("long").alias("end")))).otherwise(saved.cast(EMPTY))
    return F.when(saved.isNotNull() & (F.size(saved) > 0) & (one["end"] <= file_len), kept).otherwise(default)


def with_saved(files: DataFrame, saved: DataFrame, inode: str = "inode") -> DataFrame:
    """Files with the state saved for their inode; files that have none pass with nulls."""
    return files.join(saved, inode, "left")


def live_only(saved: DataFrame, files: DataFrame, inode: str = "inode") -> DataFrame:
    """Saved state without that of inodes that no file has any more."""
    return saved.join(files.select(inode), inode, "left_semi")
