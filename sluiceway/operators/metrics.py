"""Counters, gauges, histograms and rates of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# Bucket bounds of request sizes (bytes), durations in milliseconds and in seconds, and of journal records.
SIZE_BOUNDS = [500.0 * 2**i for i in range(13)]
MS_BOUNDS = [0.1 * 4**i for i in range(10)]
SECOND_BOUNDS = [0.0001 * 4**i for i in range(10)]
JOURNAL_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def counters(rows: DataFrame, by: list[str], size: str | None = None) -> DataFrame:
    more = [F.sum(size).cast("long").alias("bytes")] if size else []
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *more)


def histogram(rows: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts for each bound and +Inf: (by.., le, n). Each row is looked at once; sums are combined map-side."""
    by = by or []
    sums = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("b_inf"))
    cells = [F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("b_inf").alias("n"))]
    return sums.select(*by, F.inline(F.array(*cells)))


def gauge(changes: DataFrame, by: str, delta: str) -> DataFrame:
    return changes.groupBy(by).agg(F.sum(delta).cast("long").alias("value"))


def rates(samples: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Last value of a counter over the whole seconds between its first and last sample (null within one second), and its average."""
    seconds = F.floor((F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))) / 1000)
    last = F.max_by(value, ts)
    return samples.groupBy(*by).agg(last.alias("total"), (last / F.nullif(seconds, F.lit(0))).alias("rate"), F.max(value).alias("peak"))


def falling(samples: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Samples of a counter that are below the one before: none, if all is well."""
    w = Window.partitionBy(*by).orderBy(ts)
    return samples.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before"))


def received(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Lines as a receiver takes them, with ``value``, which ends with a line end: those of null are none, and those of no file are ``" unknown"``'s."""
    value = F.when(F.endswith(F.col(line), F.lit("\n")), F.col(line)).otherwise(F.concat(F.col(line), F.lit("\n")))
    return lines.where(F.col(line).isNotNull()).withColumns({file: F.coalesce(F.col(file), F.lit(" unknown")), "value": value})


def per_file(lines: DataFrame, file: str = "file", order: str = "timestamp", last: tuple[str, ...] = ("level", "meta")) -> DataFrame:
    """Lines of each file: how many, and what the last one has in the columns ``last``, null if it has nothing. Of lines that have a ``value`` (see ``received``), their bytes, too; a file's values stay rows."""
    sizes = [F.sum(F.octet_length("value")).cast("long").alias("bytes")] if "value" in lines.columns else []
    return lines.groupBy(file).agg(F.count(F.lit(1)).alias("n"), *sizes, *[F.max_by(c, order).alias(f"last_{c}") for c in last])


def exposition(name: Column, labels: Column, value: Column) -> Column:
    """A sample in the Prometheus text format."""
    quoted = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"')))
    inside = F.when(F.size(quoted) > 0, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))).otherwise("")
    return F.concat(name, inside, F.lit(" "), value.cast("string"))


def observed(lines: DataFrame, name: str, line: str = "line") -> tuple[DataFrame, Observation]:
    """The lines and an observation of their number and bytes, made while they pass."""
    seen = Observation(name)
    return lines.observe(seen, F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(line)).alias("bytes")), seen


def observed_stream(lines: DataFrame, name: str, line: str = "line") -> DataFrame:
    """The same for a stream: each micro-batch's numbers reach the listeners of queries (see ``streaming.live``)."""
    return lines.observe(name, F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0)).alias("bytes"))


def drops(kept: DataFrame, by: str = "source_kind", test: str = "kept") -> DataFrame:
    """Lines in, out and dropped by kind of source; every dropped line counts."""
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("ingress"), F.count_if(F.col(test)).alias("egress"), F.count_if(~F.coalesce(F.col(test), F.lit(False))).alias("dropped"))


#: Outcomes of a request, and the names of their counts.
OUTCOMES = {"success": "requests_succeeded", "failure": "requests_failed", "timeout": "requests_timed_out"}


def request_summary(requests: DataFrame, outcome: str = "outcome", seconds: str = "seconds", size: str = "size", by: list[str] | None = None) -> DataFrame:
    """Requests as one row for each group: how many and how large, the counts by outcome, and the duration as the sum of the three outcomes' sums."""
    by = by or []
    per = [F.count_if(F.col(outcome) == o).alias(n) for o, n in OUTCOMES.items()]
    spent = [F.coalesce(F.sum(F.when(F.col(outcome) == o, F.col(seconds))), F.lit(0.0)) for o in OUTCOMES]
    return requests.groupBy(*by).agg(F.count(size).alias("requests"), F.coalesce(F.sum(size), F.lit(0)).alias("requests_size"), *per, (spent[0] + spent[1] + spent[2]).alias("requests_duration"))


def summary_line(groups: dict[str, Column]) -> Column:
    """The periodic line of metrics: one JSON object with an object for each group (a struct)."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in groups.items()]))


def event_summary(events: DataFrame, kind: str = "kind", lines: str = "lines", size: str = "bytes") -> DataFrame:
    """One row: creates, deletes and writes, their sum as events, lines and bytes."""
    counts = {"creates": "create", "deletes": "remove", "writes": "write"}
    rows = events.agg(*[F.count_if(F.col(kind) == k).alias(n) for n, k in counts.items()], F.coalesce(F.sum(lines), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    return rows.select((F.col("creates") + F.col("deletes") + F.col("writes")).alias("events"), *counts, "lines", "bytes")
