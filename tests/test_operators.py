import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.quantities import cpu_milli, human_bytes, human_duration, memory_bytes
from sluiceway.functions.templates import substitute
from sluiceway.operators import batching, events, kube, meta, spans
from sluiceway.operators.enrich import parse_container_path, split_image


def values(spark, kind, items, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_cpu(spark):
    cases = {"": None, "0u": 0, "100": 100000, "100rrr": None, "100m": 100, "1000u": 1, "10u": 1, "1.5": 15000, "abc": None, "5n": 1}
    assert values(spark, "string", list(cases), cpu_milli) == list(cases.values())
    assert values(spark, "string", ["1.5", "0.5"], lambda x: cpu_milli(x, strict=True)) == [1500, 500]


def test_memory(spark):
    cases = {"": None, "ki": None, "1000": 1000, "1000mi": 1048576000, "1000gi": 1073741824000, "1000ti": 1099511627776000, "1000k": 1000000, "1000m": 1000000000, "1000g": 1000000000000, "2xx": 2048}
    assert values(spark, "string", list(cases), memory_bytes) == list(cases.values())
    assert human_bytes("10 MB") == 10_000_000 and human_bytes("2KiB") == 2048


def test_duration(spark):
    assert values(spark, "bigint", [0, 61, 3600, 90061, 31557600 + 2 * 2630016], human_duration) == ["", "1m 1s", "1h", "1day 1h 1m 1s", "1year 2months"]


def test_substitute(spark):
    known = {"val1": F.lit("1"), "val2": F.lit(None).cast("string")}
    t = substitute("${val1} ${val2|two} ${val3|3} ${val4|} ${val5}", known.get)
    assert spark.range(1).select(t).first()[0] == "1 two 3  ${val5}"


def test_map_merge_and_prefix(spark):
    row = spark.createDataFrame([({"a": "1", "b": "", "c": "3"},)], "m map<string,string>")
    over = F.create_map(F.lit("a"), F.lit(""), F.lit("d"), F.lit("4"))
    assert row.select(meta.merge_map(F.col("m"), over)).first()[0] == {"b": "", "c": "3", "d": "4"}
    assert values(spark, "string", ["2024-01-02T03:04:05.1+00:00 stderr P hello", "x"], meta.strip_runtime_prefix) == ["hello", "x"]


def test_overrides_in_order(spark):
    lines = spark.createDataFrame([("t", "/var/log/containers/x", "a", "h", "e", None, {"k": "v"}, None)], "line string, file string, app string, host string, env string, meta string, labels map<string,string>, annotations map<string,string>")
    o = meta.Overrides(app="${label.k}-${line.app}", host="${line.app}", meta='{"x": "${env.Z}"}', labels={"k": "", "n": "${line.env}"}, environment={"Z": "z"})
    r = o.apply(lines).first()
    assert (r.app, r.host, r.labels, r.meta) == ("v-a", "a", {"n": "e"}, '{"x":"z"}')
    assert meta.Overrides().apply(lines) is lines


def test_images_and_paths(spark):
    rows = spark.createDataFrame([("a:1",), ("a",), ("h:5/x:2",)], "i string").select(*split_image(F.col("i"))).collect()
    assert [tuple(r) for r in rows] == [("a", "1"), ("a", None), ("h", "5/x:2")]
    good = "/var/log/containers/p_n_c-d-" + "0" * 64 + ".log"
    got = values(spark, "string", [good, "/var/log/x.log", None], parse_container_path)
    assert tuple(got[0]) == ("p", "n", "c-d") and got[1:] == [None, None]


def cover(rows):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def test_span_union_both_ways(spark):
    rnd = random.Random(1)
    data = {k: [(s, s + rnd.randint(0, 9)) for s in (rnd.randint(0, 120) for _ in range(rnd.randint(1, 15)))] for k in range(40)}
    rows = spark.createDataFrame([(k, a, b) for k, xs in data.items() for a, b in xs], "k int, start bigint, end bigint")
    got = {}
    for r in spans.coalesce_spans(rows, "k").collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: cover(v) for k, v in data.items()}
    arrays = rows.groupBy("k").agg(spans.merge_array(F.collect_list(F.struct("start", "end"))).alias("s")).collect()
    assert {r.k: [tuple(x) for x in r.s] for r in arrays} == {k: cover(v) for k, v in data.items()}


@pytest.mark.parametrize("have,cut,left", [([(0, 10)], (3, 5), [(0, 3), (5, 10)]), ([(0, 4), (6, 9)], (0, 9), []), ([(0, 5)], (3, 8), [(0, 2)]), ([(4, 9)], (2, 6), [(6, 9)]), ([(0, 1)], (5, 6), [(0, 1)]), ([], (1, 2), [])])
def test_span_remove(spark, have, cut, left):
    row = spark.createDataFrame([(have,)], "s array<struct<start:bigint,end:bigint>>")
    assert [tuple(x) for x in row.select(spans.remove_span(F.col("s"), F.lit(cut[0]), F.lit(cut[1]))).first()[0]] == left


def test_first_gap_and_lookback(spark):
    kind = "array<struct<start:bigint,end:bigint>>"
    gaps = values(spark, kind, [[], [(0, 5)], [(0, 5), (9, 12)], [(4, 6)]], spans.first_gap)
    assert [tuple(g) for g in gaps] == [(0, None), (5, None), (5, 8), (0, 3)]
    t = dt.datetime(2024, 1, 1)
    cases = [("start", 9, t, None), ("none", 9, t, None), ("smallfiles", 8191, t, None), ("smallfiles", 8192, t, None), ("tail", 9, t, None), ("tail", 9, t + dt.timedelta(1), None), ("start", 9, t, [(3, 7)]), ("start", 9, t, [(0, 70)])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, m string, n bigint, c timestamp, s {kind}")
    got = rows.select("i", spans.initial_spans(F.col("m"), F.col("n"), F.col("c"), F.lit(t), F.col("s")).alias("x")).collect()
    assert [[tuple(y) for y in r.x] for r in sorted(got)] == [[], [(0, 9)], [], [(0, 8192)], [(0, 9)], [], [(0, 7)], []]


def test_batches(spark):
    sizes = [400, 700, 10, 2000, 1, 999, 1]
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "s string, i int, n int")
    got = {r.i: r.batch_id for r in batching.assign_batches(rows, "s", "i", "n", 1000).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 1, 2, 2, 3]
    body = batching.bodies(batching.assign_batches(rows.withColumn("line", F.lit("x")), "s", "i", "n", 10**9), "s", "i").first().body
    assert body.count('"line":"x"') == 7


def test_outcomes(spark):
    assert values(spark, "int", [200, 429, 404, None, 503], batching.outcome) == ["delivered", "retry", "fatal", "retry", "retry"]


def test_high_water(spark):
    t = dt.datetime(2024, 1, 1)
    at = [0, 10, 9, 7, None, 30, 28, 29]
    rows = spark.createDataFrame([(i, None if x is None else t + dt.timedelta(seconds=x)) for i, x in enumerate(at)], "seq int, creation_ts timestamp")
    assert sorted(r.seq for r in events.high_water(rows).collect()) == [0, 1, 2, 4, 5, 7]
    # with nothing but a floor known, a row without a time is dropped; behind one that passed it is kept
    at = [None, 3, 5, None, 4]
    rows = spark.createDataFrame([(i, None if x is None else t + dt.timedelta(seconds=x)) for i, x in enumerate(at)], "seq int, creation_ts timestamp")
    assert sorted(r.seq for r in events.high_water(rows, floor=F.lit(t + dt.timedelta(seconds=3))).collect()) == [2, 3, 4]
    assert sorted(r.seq for r in events.high_water(rows.where("seq <> 1")).collect()) == [0, 2, 3, 4]


def test_a_body_that_fits_behind_one_that_does_not(spark):
    sizes = [60, 50, 30, 20, None, 10, 1]
    rows = spark.createDataFrame(list(enumerate(sizes)), "name int, bytes int")
    got = [(r.kept, r.used) for r in batching.within_quota(rows, 100, None).orderBy("name").collect()]
    assert got == [(True, 60), (False, 60), (True, 90), (False, 90), (True, 90), (True, 100), (False, 100)]


def test_long_chains_and_cycles_of_links(spark):
    from sluiceway.operators.fsgraph import reachable

    rows = [(f"/d{i}/next", f"/d{i + 1}", False) for i in range(60)] + [(f"/d{i}/file", None, False) for i in range(62)] + [("/watch/l", "/d0", True), ("/d60/back", "/d7", False), ("/far/a", "/far", False)]
    found = {r.path for r in reachable(spark.createDataFrame(rows, "path string, link_target string, is_target boolean")).where("reachable").collect()}
    assert found == {p for p, _, _ in rows} - {"/d61/file", "/far/a"}


def test_cluster_sums(spark):
    rows = spark.createDataFrame([("a", 1, True), ("b", None, False), ("c", 3, None), ("d", 4, True)], "node string, cpu_usage bigint, ready boolean").withColumn("unschedulable", F.lit(True))
    assert kube.cluster_report(rows).first().cpu_usage == 8
    r = kube.cluster_report(rows, order="node").first()
    assert (r.cpu_usage, r.nodes_ready, r.nodes_notready, r.nodes_unschedulable) == (7, 2, 2, 4)


def test_event_messages(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(1, "Pod", "web", "spec.containers{app}", None, "R", "m", 3, t, t + dt.timedelta(seconds=75), None), (2, "Node", "n1", None, "Warning", "R", "m", None, None, None, t), (3, "Pod", "w", None, None, "R", "m", 2, t, t, None), (4, "Pod", "w", None, None, None, "m", 2, t, t, None)],
        "i int, obj_kind string, obj_name string, field_path string, type string, reason string, message string, count int, first_ts timestamp, last_ts timestamp, event_ts timestamp",
    ).withColumn("component", F.lit("kubelet"))
    got = [(r.event_host, r.app, r.level, r.message_line) for r in events.event_lines(rows).orderBy("i").collect()]
    assert got == [("web", "app", "Normal", "R  (x3 over 1m 15s)  m"), ("Node/n1", "kubelet", "Warning", "R  m"), ("w", "kubelet", "Normal", "R  (x2 just now)  m"), ("w", "kubelet", "Normal", None)]


def asked_from_the_end(spark, strict, step):
    """The next starts of 2000 rows with values 0, 3, 6, ..., and whether a frame runs to the last row, which Spark sums up anew for each row."""
    from sluiceway.operators import chains

    rows = spark.range(2000).select(F.lit("a").alias("k"), (F.col("id") + 1).alias("place"), (F.col("id") * 3).alias("v"))
    found = chains.next_starts(rows, F.col("v"), F.col("v") + 30, strict=strict, step=step)
    return {r.place: r.next for r in found.collect()}, "unboundedfollowing" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_next_batches_are_found_in_one_pass_over_a_part(spark):
    got, looks_ahead = asked_from_the_end(spark, strict=False, step=1)
    assert got == {i: i + 11 if i + 10 <= 2000 else None for i in range(1, 2001)} and not looks_ahead


def test_next_windows_are_found_in_one_pass_over_a_part(spark):
    got, looks_ahead = asked_from_the_end(spark, strict=True, step=0)
    assert got == {i: i + 11 if i + 11 <= 2000 else None for i in range(1, 2001)} and not looks_ahead


def test_tasks_that_join_spans_grow_in_number(spark, monkeypatch):
    """Spans of 3000 files at 100 a task: no task gets a quarter of them, as with the session's four partitions."""
    monkeypatch.setattr(spans, "TASK_ROWS", 100, raising=False)
    rows = spark.range(3000).select(F.col("id").alias("file_id"), (F.col("id") % 2).alias("batch_id"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))
    for df in (spans.coalesce_spans(rows, "file_id"), spans.merge_offsets(rows)):
        dealt = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in dealt) == 3000 and max(r["count"] for r in dealt) < 300


def test_starts_of_many_parts_equal_a_walk(spark, monkeypatch):
    """Keys of one row, of parts of parts and of many parts, null, steps within parts and over several, gaps, and rows that stand evenly."""
    from itertools import groupby

    from sluiceway.operators import chains

    monkeypatch.setattr(chains, "PART_ROWS", 40)
    rng = random.Random(7)
    spread = {"hot": rng.sample(range(9000), 900), None: rng.sample(range(400), 70), "even": range(0, 2100, 7), "one": [5], "gap": [*range(90), *range(5000, 5090)], **{f"t{i}": range(i, i + 3) for i in range(60)}}
    rows = [(k, v - 50, rng.randrange(1, 5)) for k, values in spread.items() for v in values]
    table = spark.createDataFrame(rows, "k string, v bigint, size bigint").repartition(3)
    for step in (1, 35, 700, 3000):
        want = []
        for k, own in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
            number, start, since = -1, None, 0
            for _, v, size in own:
                if start is None or v >= start + step:
                    number, start, since = number + 1, v, 0
                want.append((k, v, size, number, since))
                since += size
        assert sorted(map(tuple, chains.stepped(table, step).collect()), key=str) == sorted(want, key=str), step
    assert chains.stepped(table.where("false"), 5).count() == 0


def test_windows_of_calls_are_found_in_few_rows(spark, monkeypatch):
    """Calls of one time are a row, and the steps together write no more than three rows for each time."""
    from sluiceway.operators import chains

    monkeypatch.setattr(chains, "PART_ROWS", 500)
    written, cut = [], chains.cut

    def counting(df):
        out = cut(df)
        written.append(out.count())
        return out

    for module in (chains, events):
        monkeypatch.setattr(module, "cut", counting, raising=False)
    calls = spark.range(8000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") % 4000).alias("ts"))
    got = events.rate_limited_in_parts(calls, "k", "ts", 3, 9).groupBy("allowed").count().collect()
    assert {(r.allowed, r["count"]) for r in got} == {(True, 1200), (False, 6800)} and sum(written) <= 3 * 4000


def test_rate_limit_counts(spark):
    """Calls at one time share what is left of a window, calls without a time have none, and a limit of nothing allows nothing."""
    calls = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 1), ("a", 5), ("a", 6), (None, 1), ("b", None), ("b", None)], "k string, s bigint").select("k", F.timestamp_seconds("s").alias("ts"))
    counted = lambda limit: {(r.k, r.s, r.allowed, r.calls) for r in events.rate_limit_counts(calls, "k", "ts", limit, 5).select("k", F.unix_seconds("ts").alias("s"), "allowed", "calls").collect()}
    assert counted(3) == {("a", 0, 1, 1), ("a", 1, 2, 3), ("a", 5, 0, 1), ("a", 6, 1, 1), (None, 1, 1, 1), ("b", None, 0, 2)}
    assert {x[2] for x in counted(0)} == {0}


def test_many_calls_at_one_time_have_their_verdicts(spark):
    calls = spark.range(25_001).select(F.lit("a").alias("k"), F.timestamp_seconds(F.lit(3)).alias("ts"))
    got = events.rate_limited_in_parts(calls, "k", "ts", 20_003, 5).groupBy("k", "ts", "allowed").count().collect()
    assert {(r.allowed, r["count"]) for r in got} == {(True, 20_003), (False, 4_998)}
