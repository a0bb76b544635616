"""The watched file graph: symbolic links and what can be reached through them, and events that name files by inode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.lineage import cut

def ancestors(path: Column) -> Column:
    """The path and all directories above it but the root, the deepest first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def reachable(entries: DataFrame, path: str = "path", target: str = "link_target", watched: str = "is_target") -> DataFrame:
    """Entries with ``reachable``: watched themselves, or at or below the target of a symbolic link that is reachable.

    ``entries``: one row for each path, with a symbolic link's target (null for others) and whether the rules watch the path.
    Links of any number in a row are followed. The targets make a graph: one leads to those of the links at or below it. Each round joins
    the steps with themselves, so they get twice as long, and takes all that they reach from what is found; when a round finds nothing
    new, nothing is further away, so cycles end. Steps and found targets are written each round.
    """
    links = entries.where(F.col(target).isNotNull()).select(F.col(path).alias("link"), F.col(target).alias("to"), F.col(watched).alias("seed"))
    above = links.select("to", F.explode(ancestors(F.col("link"))).alias("at"))
    nodes = links.select(F.col("to").alias("at")).distinct()
    steps = cut(above.join(nodes, "at", "left_semi").select("at", "to").distinct())
    found = cut(links.where("seed").select(F.col("to").alias("at")).distinct())
    known = found.count()
    while True:
        found = cut(found.unionByName(found.join(steps, "at").select(F.col("to").alias("at"))).distinct())
        now = found.count()
        if now == known:
            break
        known = now
        further = steps.select(F.col("at").alias("to"), F.col("to").alias("end"))
        steps = cut(steps.join(further, "to").select("at", F.col("end").alias("to")).distinct())
    own = entries.select(F.col(path).alias("p"), F.explode(ancestors(F.col(path))).alias("at")).join(found, "at", "left_semi").select("p").distinct()
    marked = entries.join(own.withColumn("__linked", F.lit(True)), F.col(path) == F.col("p"), "left")
    return marked.withColumn("reachable", F.col(watched) | F.coalesce("__linked", F.lit(False))).drop("p", "__linked")


def resume_events(resumed: DataFrame, files: DataFrame, inode: str = "inode", path: str = "path") -> DataFrame:
    """Files to be read on (inode, ts) as write events of their paths; inodes that no watched file has any more say nothing."""
    known = files.select(inode, F.col(path).alias("path"))
    return resumed.join(known, inode).select("path", F.lit("write").alias("kind"), "ts", inode)


def debounced(events: DataFrame, path: str = "path", order: str = "seq", ts: str = "ts", kind: str = "kind", resumed: str | None = None) -> DataFrame:
    """Events in the order in which a debouncer lets them go: rows with ``due``, ascending.

    Of each path the events come in order, runs of writes as one write with the earliest time; a resumed write stands in front and joins a
    write there. Errors and rescans are not queued. Of several paths the one whose next event is the oldest goes first: an
    event waits for those of its path before it, so it is due at the latest time of these and its own.
    """
    from pyspark.sql import Window

    front = F.col(resumed) if resumed else F.lit(False)
    rows = events.where(F.col(kind).isin("create", "write", "remove", "rename")).withColumn("__front", F.when(front, 0).otherwise(1))
    w = Window.partitionBy(path).orderBy("__front", order)
    starts = (F.col(kind) != "write") | F.coalesce(F.lag(kind).over(w) != "write", F.lit(True))
    runs = rows.withColumn("__run", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    one = runs.groupBy(path, "__run", kind).agg(F.min(ts).alias(ts), F.min(order).alias(order), F.count(F.lit(1)).alias("n"))
    return one.withColumn("due", F.max(ts).over(Window.partitionBy(path).orderBy("__run"))).drop("__run")


def delayed(items: DataFrame, arrival: str, delay: str | None, default_seconds: float) -> DataFrame:
    """Items with ``due``: their arrival and their own delay in seconds, or the default where they have none."""
    own = F.coalesce(F.col(delay), F.lit(default_seconds)) if delay else F.lit(default_seconds)
    return items.withColumn("due", F.timestamp_micros(F.unix_micros(F.col(arrival).cast("timestamp")) + (own * 1_000_000).cast("long")))


def ready(items: DataFrame, now: Column) -> DataFrame:
    """Delayed items whose time has passed."""
    return items.where(now > F.col("due"))
