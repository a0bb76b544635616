"""The queries and operators over whole inputs: no text, line or group is left out."""

import os
import re

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import batching, events
from sluiceway.operators.redact import redact
from sluiceway.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@tables
def test_redact_multi_runs_over_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert any(len(r.text or "") >= 3000 for r in docs)
    plain = lambda t: None if t is None else re.sub("[0-9a-f.@]+", "[REDACTED]", t)
    got = sorted(((r.doc_id, r.line) for r in QUERIES["redact_multi_runs"](spark, DATA).collect()), key=str)
    assert got == sorted(((r.doc_id, plain(r.text)) for r in docs), key=str)


def test_redact_of_many_matches_in_one_text(spark):
    text = "a1 b2é " * 60_000
    out = spark.createDataFrame([(text,)], "line string").select(redact(F.col("line"), ["[0-9]", "[a-f]"])).first()[0]
    assert out == "[REDACTED] [REDACTED]é " * 60_000


def lines_of(text):
    lines = (text or "").split("\n")
    return lines[:-1] if len(lines) > 1 and not lines[-1] else lines


@tables
def test_union_and_strip_take_every_line_of_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()
    assert any(len(lines_of(r.text)) > 1 for r in docs)
    got = QUERIES["union_sources"](spark, DATA).where("source_kind = 'doc'").select("line", "app").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((x, r.source)) for r in docs for x in lines_of(r.text))
    others = sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("events", "conversations"))
    assert QUERIES["union_sources"](spark, DATA).where("source_kind <> 'doc'").count() == others
    stripped = [(r.doc_id, x if r.doc_id % 2 == 0 and x else f"plain {x}") for r in docs for x in lines_of(r.text)]
    assert sorted(map(tuple, QUERIES["crio_strip"](spark, DATA).collect())) == sorted(stripped)


def test_folds_of_one_large_group_and_of_null_keys(spark):
    """Three hundred thousand rows of one key, and rows of null keys, which joins would lose."""
    n, size = 300_000, 10
    rows = spark.range(n + 4).select(F.when(F.col("id") < n, "hot").alias("k"), F.col("id").alias("seq"), F.lit(size).alias("n"), F.timestamp_seconds(F.col("id")).alias("ts"))
    dealt = batching.assign_batches(rows, "k", "seq", "n", 2 * size).groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("batch_id").alias("last")).collect()
    assert {(r.k, r.rows, r.last) for r in dealt} == {("hot", n, n // 2 - 1), (None, 4, 1)}
    new = events.high_water(rows.withColumn("creation_ts", F.when(F.col("seq") % 3 == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("ts"))), key="k").groupBy("k").count().collect()
    # an old time passes at the very first row, and at the second one, as a mark of zero isn't taken; null has 300000 to 300003, of which the last comes late
    assert {(r.k, r["count"]) for r in new} == {("hot", 2 + n * 2 // 3), (None, 3)}
    calls = events.rate_limited(rows, "k", "ts", 2, 3).groupBy("k").agg(F.count(F.lit(1)).alias("calls"), F.count_if("allowed").alias("allowed")).collect()
    assert {(r.k, r.calls, r.allowed) for r in calls} == {("hot", n, n // 2), (None, 4, 2)}


def test_one_stream_in_many_parts_equals_the_fold(spark, monkeypatch):
    """Streams of one row, hot ones, null keys and sizes, sizes of zero, batches longer than parts, and calls at the same time."""
    import random

    from sluiceway.operators import chains

    monkeypatch.setattr(chains, "PART_ROWS", 60)
    rng = random.Random(4)
    rows = [("hot", i, rng.choice((0, 1, 5, 40, None)), i // 3 * rng.choice((7, 7, 7, 8))) for i in range(900)] + [(None, i, 30, i) for i in range(40)] + [("one", 1, 5, 5), ("long", 1, 500, 0), ("long", 2, 1, 9)] + [("tiny", i, 1, 10**6) for i in range(200)]
    table = spark.createDataFrame(rows, "k string, seq int, n int, s bigint").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    plain = {(r.k, r.seq): r.batch_id for r in batching.assign_batches(table, "k", "seq", "n", 100).collect()}
    parts = batching.assign_batches_in_parts(table, "k", "seq", "n", 100)
    got = parts.collect()
    assert {(r.k, r.seq): r.batch_id for r in got} == plain and len(got) == len(rows) and parts.columns == [*table.columns, "batch_id"]
    assert {r.batch_id for r in got if r.k == "tiny"} == {0, 1} and max(plain[k, i] for k, i in plain if k == "hot") > 50
    calls = table.select("k", F.when(F.col("seq") != 7, F.col("ts")).alias("ts"))
    count = lambda df: sorted(map(tuple, df.groupBy("k", "ts", "allowed").count().collect()), key=str)
    assert count(events.rate_limited_in_parts(calls, "k", "ts", 4, 30)) == count(events.rate_limited(calls, "k", "ts", 4, 30))
    assert batching.assign_batches_in_parts(table.where("false"), "k", "seq", "n", 100).count() == 0


@tables
def test_report_lines_say_what_the_reports_say(spark):
    """Each line is one report row: its entries are the row's values, null ones left out."""
    import json
    from collections import Counter

    import duckdb

    from sluiceway.plans.queries import SQL

    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    lines = [json.loads(r.line)["kube"] for r in QUERIES["report_json"](spark, DATA).collect()]
    assert all(x["type"] == "metric" and None not in x.values() for x in lines)
    for resource, name in (("node", "node_report"), ("container", "container_report"), ("cluster", "cluster_report")):
        found = duck.execute(SQL[name])
        names = [c[0] for c in found.description]
        want = Counter(tuple(sorted((k, str(v)) for k, v in zip(names, row, strict=True) if v is not None)) for row in found.fetchall())
        own = Counter(tuple(sorted((k, str(v)) for k, v in x.items() if k in names)) for x in lines if x["resource"] == resource)
        assert own == want and own
