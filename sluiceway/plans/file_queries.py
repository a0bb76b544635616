"""Queries on the watched file graph, on requests and on saved state, over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluiceway.functions import bytes as edges
from sluiceway.operators import enrich, events, fsgraph, meta, metrics, rules, spans
from sluiceway.operators.lineage import shared_folder
from sluiceway.plans import inputs
from sluiceway.plans.inputs import CONTAINERS, table
from sluiceway.plans.registry import query
from sluiceway.sources import files, retry, walk


@query(f"WITH {CONTAINERS} SELECT c_custkey, file LIKE '/var/log/containers/%' AND (file LIKE '%5.log' OR c_custkey % 3 = 0) AS passes FROM cl WHERE file IS NOT NULL")
def dir_rules(spark, d):
    """Watched directories: files pass the file rules too, directories need not."""
    lines = inputs.container_lines(spark, d).where("file IS NOT NULL")
    dirs, master = rules.PathRules.of_dirs(["/var/log/containers/"]), rules.PathRules(("*5.log",), ())
    return lines.select("c_custkey", rules.is_target(F.col("file"), F.col("c_custkey") % 3 == 0, dirs, master).alias("passes"))


_ENTRIES = """e AS (SELECT '/data/d' || (o_orderkey % 50) || '/f' || o_orderkey AS path, NULL::VARCHAR AS target, false AS seed FROM orders
UNION ALL SELECT '/watch/l' || i, '/data/d' || i, true FROM range(20) AS t(i) UNION ALL SELECT '/data/d' || i || '/next', '/data/d' || (i + 20), false FROM range(10) AS t(i)
UNION ALL SELECT '/data/d' || a || '/loop', '/data/d' || b, false FROM (VALUES (45, 46), (46, 45), (47, 3)) AS t(a, b))"""


@query(f"""WITH RECURSIVE {_ENTRIES}, f AS (SELECT path, target FROM e WHERE seed UNION SELECT e.path, e.target FROM e JOIN f ON e.target IS NOT NULL AND (e.path = f.target OR starts_with(e.path, f.target || '/')))
SELECT path, seed OR EXISTS (SELECT 1 FROM f WHERE e.path = f.target OR starts_with(e.path, f.target || '/')) AS reachable FROM e""")
def reachable_links(spark, d):
    """Files behind symbolic links, and links behind those; a cycle that nothing watched points to is not reached."""
    name = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    k, i = F.col("o_orderkey"), F.col("id")
    none = F.lit(None).cast("string")
    files = table(spark, d, "orders").select(name("/data/d", (k % 50).cast("string"), "/f", k.cast("string")).alias("path"), none.alias("link_target"), F.lit(False).alias("is_target"))
    watched = spark.range(20).select(name("/watch/l", i.cast("string")).alias("path"), name("/data/d", i.cast("string")).alias("link_target"), F.lit(True).alias("is_target"))
    chained = spark.range(10).select(name("/data/d", i.cast("string"), "/next").alias("path"), name("/data/d", (i + 20).cast("string")).alias("link_target"), F.lit(False).alias("is_target"))
    loops = spark.createDataFrame([(f"/data/d{a}/loop", f"/data/d{b}", False) for a, b in ((45, 46), (46, 45), (47, 3))], "path string, link_target string, is_target boolean")
    entries = files.unionByName(watched).unionByName(chained).unionByName(loops)
    return fsgraph.reachable(entries).select("path", "reachable")


@query("""SELECT '/chain/c' || o_custkey || '/o' || o_orderkey AS path, o_custkey % 97 >= 5 AS reachable FROM orders
UNION ALL SELECT '/chain/c' || c_custkey || '/next', c_custkey % 97 >= 5 FROM customer UNION ALL SELECT '/watch/c' || c_custkey, true FROM customer WHERE c_custkey % 97 = 5""")
def reachable_chains(spark, d):
    """Customers' directories, each with a link to the next one's: chains of 97 links, watched from the sixth on, and the orders as files."""
    name = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    none, k, o = F.lit(None).cast("string"), F.col("c_custkey"), F.col("o_custkey")
    files = table(spark, d, "orders").select(name("/chain/c", o, "/o", F.col("o_orderkey")).alias("path"), none.alias("link_target"), F.lit(False).alias("is_target"))
    c = table(spark, d, "customer")
    links = c.select(name("/chain/c", k, "/next").alias("path"), F.when(k % 97 == 96, F.lit("/none")).otherwise(name("/chain/c", k + 1)).alias("link_target"), F.lit(False).alias("is_target"))
    watched = c.where("c_custkey % 97 = 5").select(name("/watch/c", k).alias("path"), name("/chain/c", k).alias("link_target"), F.lit(True).alias("is_target"))
    return fsgraph.reachable(files.unionByName(links).unionByName(watched)).select("path", "reachable")


@query("""SELECT 'n' || c_nationkey || '/' || lower(c_mktsegment) || '/c' || c_custkey || '.log' AS path, strlen(c_name)::BIGINT AS size FROM customer WHERE c_nationkey NOT BETWEEN 10 AND 19 AND c_custkey % 4 <> 0""")
def walk_pruned(spark, d):
    """Customers as files of a tree that tasks write, listed again by tasks; directories of some nations aren't entered, and files of other endings are left out."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    ending = F.when(F.col("c_custkey") % 4 == 0, ".tmp").otherwise(".log")
    name = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey").cast("string"), ending)
    tree = table(spark, d, "customer").select(name.alias("path"), F.col("c_name").alias("text"))
    files.write_tree(tree, root)
    found = walk.walk(spark, [root], rules.PathRules(("*.log",), (f"{root}/n1?/*", "*/n1?/*")))
    return found.where("kind = 'file'").select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), "size")


@query("""WITH e AS (SELECT p_partkey AS k, 100 + p_partkey AS inode, '/t/d' || (p_partkey % 10) AS dir, CASE p_partkey % 10 WHEN 3 THEN '/t/x3' WHEN 4 THEN '/t/y5/d4' WHEN 5 THEN '/t/y5' ELSE '/t/d' || (p_partkey % 10) END AS now FROM part)
SELECT dir || '/p' || k AS path, CASE WHEN k % 11 = 0 THEN 'remove' ELSE 'rename' END AS kind, CASE WHEN k % 11 <> 0 THEN now || '/q' || k END AS to_path, inode FROM e WHERE k % 11 = 0 OR k % 7 = 0
UNION ALL SELECT now || '/p' || k, 'write', NULL, inode FROM e WHERE k % 11 <> 0 AND k % 7 <> 0 AND k % 3 = 0
UNION ALL SELECT '/t/links/l' || k, 'link', NULL, inode FROM e WHERE k % 13 = 0 AND k % 11 <> 0 AND k % 7 <> 0
UNION ALL SELECT '/t/d' || (k % 10) || '/new' || k, 'create', NULL, 10000000 + k FROM e WHERE k % 17 = 0 AND k % 10 NOT IN (3, 4, 5)
UNION ALL SELECT * FROM (VALUES ('/t/d3', 'rename', '/t/x3', 3), ('/t/d4', 'rename', '/t/y5/d4', 4), ('/t/d5', 'rename', '/t/y5', 5))""")
def tree_moves(spark, d):
    """Parts as files of ten directories, three of which move, one into another that moves itself: what moved with them is no event; some files are renamed, removed, written, linked or new."""
    k = F.col("p_partkey")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    part = table(spark, d, "part")
    row = lambda rows, path, inode, size: rows.select(path.alias("path"), inode.cast("long").alias("inode"), size.cast("long").alias("size"), F.lit("file").alias("kind"))
    digit = k % 10
    now = F.when(digit == 3, "/t/x3").when(digit == 4, "/t/y5/d4").when(digit == 5, "/t/y5").otherwise(say("/t/d", digit))
    folders = lambda names: spark.createDataFrame([(p, i, None, "dir") for i, p in names.items()], "path string, inode bigint, size bigint, kind string")
    old = {i: f"/t/d{i}" for i in range(10)}
    before = row(part, say("/t/d", digit, "/p", k), k + 100, F.col("p_size")).unionByName(folders(old))
    left = part.where("p_partkey % 11 <> 0")
    after = row(left, F.concat(now, F.when(k % 7 == 0, "/q").otherwise("/p"), k.cast("string")), k + 100, F.col("p_size") + F.when((k % 3 == 0) & (k % 7 != 0), 1).otherwise(0))
    after = after.unionByName(row(left.where("p_partkey % 13 = 0 AND p_partkey % 7 <> 0"), say("/t/links/l", k), k + 100, F.col("p_size")))
    after = after.unionByName(row(part.where("p_partkey % 17 = 0 AND p_partkey % 10 NOT IN (3, 4, 5)"), say("/t/d", digit, "/new", k), k + 10_000_000, F.lit(1)))
    return events.tree_events(before, after.unionByName(folders({**old, 3: "/t/x3", 4: "/t/y5/d4", 5: "/t/y5"})))


@query("SELECT '/var/log/o' || o_orderkey AS path, 'write' AS kind, l_shipdate AS ts, o_orderkey AS inode FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0")
def resume_events(spark, d):
    files = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("inode"), F.concat(F.lit("/var/log/o"), F.col("o_orderkey").cast("string")).alias("path"))
    resumed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode"), F.col("l_shipdate").alias("ts"))
    return fsgraph.resume_events(resumed, files)


@query("""SELECT event_id, epoch_us(ts) + CASE WHEN event_id % 3 = 0 THEN 2500000 ELSE (event_id % 3) * 1000000 END AS due_us FROM events""")
def delayed_due(spark, d):
    items = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 3).cast("double")).alias("delay"))
    return fsgraph.delayed(items, "ts", "delay", 2.5).select("event_id", F.unix_micros("due").alias("due_us"))


@query("""WITH e AS (SELECT user_id AS path, event_id AS seq, ts, ['create', 'write', 'write', 'remove', 'rescan'][event_id % 5 + 1] AS kind, CASE WHEN event_id % 11 = 1 THEN 0 ELSE 1 END AS front FROM events),
q AS (SELECT * FROM e WHERE kind <> 'rescan'),
r AS (SELECT *, sum(CASE WHEN kind <> 'write' OR coalesce(p, '') <> 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY front, seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY front, seq) AS p FROM q)),
o AS (SELECT path, g, kind, min(ts) AS ts, min(seq) AS seq, count(*) AS n FROM r GROUP BY path, g, kind)
SELECT path, kind, ts, seq, n, max(ts) OVER (PARTITION BY path ORDER BY g ROWS UNBOUNDED PRECEDING) AS due FROM o""")
def debounced_events(spark, d):
    kinds = F.array(*map(F.lit, ["create", "write", "write", "remove", "rescan"]))
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), "ts", F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"), (F.col("event_id") % 11 == 1).alias("resumed"))
    return fsgraph.debounced(e, resumed="resumed")


@query("""SELECT c_custkey, '?hostname=' || replace(lower(c_name), '#', '%23') || '%20x&now=' || (1700000000 + c_custkey) || CASE WHEN c_custkey % 2 = 0 THEN '&ip=10.0.0.' || (c_custkey % 250) ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '&tags=' || lower(c_mktsegment) || '%2Cprod' ELSE '' END AS params FROM customer""")
def request_params(spark, d):
    k = F.col("c_custkey")
    tags = F.when(k % 3 == 0, F.array(F.lower("c_mktsegment"), F.lit("prod"))).otherwise(F.array().cast("array<string>"))
    ip = F.when(k % 2 == 0, F.concat(F.lit("10.0.0."), (k % 250).cast("string")))
    params = edges.request_params(F.concat(F.lower("c_name"), F.lit(" x")), F.timestamp_seconds(k + 1700000000), ip=ip, tags=tags)
    return table(spark, d, "customer").select("c_custkey", edges.query_string(params).alias("params"))


_REQUESTS = "rq AS (SELECT event_type AS kind, ['success', 'success', 'failure', 'timeout', 'other'][event_id % 5 + 1] AS outcome, (event_id % 16) / 8.0 AS seconds, event_id % 4000 AS size FROM events)"


def _requests(spark, d):
    outcomes = F.array(*map(F.lit, ["success", "success", "failure", "timeout", "other"]))
    k = F.col("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("kind"), F.element_at(outcomes, (k % 5 + 1).cast("int")).alias("outcome"), (k % 16 / 8.0).alias("seconds"), (k % 4000).alias("size"))


_SUMS = "count(*) AS requests, sum(size)::BIGINT AS requests_size, count(*) FILTER (outcome = 'success') AS requests_succeeded, count(*) FILTER (outcome = 'failure') AS requests_failed, count(*) FILTER (outcome = 'timeout') AS requests_timed_out, coalesce(sum(seconds) FILTER (outcome <> 'other'), 0)::DOUBLE AS requests_duration"


@query(f"WITH {_REQUESTS} SELECT kind, {_SUMS} FROM rq GROUP BY kind")
def request_summary(spark, d):
    return metrics.request_summary(_requests(spark, d), by=["kind"])


@query(f"""WITH {_REQUESTS}, s AS (SELECT {_SUMS} FROM rq), f AS (SELECT count(*) FILTER (event_type = 'click') AS w, count(*) FILTER (event_type = 'signup') AS c, count(*) FILTER (event_type = 'error') AS r, count(*) AS n, sum(event_id % 100)::BIGINT AS b FROM events)
SELECT '{{"fs":{{"events":' || (w + c + r) || ',"creates":' || c || ',"deletes":' || r || ',"writes":' || w || ',"lines":' || n || ',"bytes":' || b || '}},"ingest":{{"requests":' || requests || ',"requests_size":' || requests_size || ',"requests_timed_out":' || requests_timed_out || ',"requests_failed":' || requests_failed || ',"requests_succeeded":' || requests_succeeded || '}}}}' AS line FROM s, f""")
def metrics_line(spark, d):
    """One JSON line for all metrics of a period; both sides are one row."""
    kinds = F.create_map(*[F.lit(x) for pair in (("click", "write"), ("signup", "create"), ("error", "remove")) for x in pair])
    fs = metrics.event_summary(table(spark, d, "events").select(F.element_at(kinds, F.col("event_type")).alias("kind"), F.lit(1).alias("lines"), (F.col("event_id") % 100).alias("bytes")))
    names = ["requests", "requests_size", "requests_timed_out", "requests_failed", "requests_succeeded"]
    both = fs.select(F.struct(*fs.columns).alias("fs")).join(metrics.request_summary(_requests(spark, d)).select(F.struct(*names).alias("ingest")), F.lit(True))
    return both.select(metrics.summary_line({"fs": F.col("fs"), "ingest": F.col("ingest")}).alias("line"))


@query(r"SELECT p_partkey, regexp_replace(p_name || chr(9) || 'é/' || chr(127) || p_size, '[^\x20-\x7e]', '', 'g') AS agent FROM part")
def printable_agent(spark, d):
    raw = F.concat("p_name", F.lit("\té/\x7f"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", edges.printable(raw).alias("agent"))


@query("""WITH s AS (SELECT l_orderkey, list(struct_pack(a := l_partkey, b := l_partkey + l_suppkey) ORDER BY l_partkey, l_suppkey) AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS file_id, printf('%016x', x[1].b) || list_reduce(list_transform(x, lambda y: printf('%016x', y.a) || printf('%016x', y.b)), lambda y, z: y || z) AS saved, list_sum(list_transform(x, lambda y: y.b - y.a))::BIGINT AS held, len(x) AS n FROM s""")
def saved_spans_codec(spark, d):
    """Spans as an old state file holds them, and read back."""
    span = F.struct(F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey")).alias("end"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    saved = rows.withColumn("data", edges.encode_spans(F.col("spans"))).withColumn("back", edges.decode_spans(F.col("data")))
    held = F.aggregate("back", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return saved.select("file_id", F.lower(F.hex("data")).alias("saved"), held.alias("held"), F.size("back").cast("long").alias("n"))


@query("SELECT o_orderkey, '1700000000_' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '.retry' AS name FROM (SELECT o_orderkey, md5(o_custkey || '/' || o_orderkey) AS h FROM orders)")
def retry_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", retry.retry_name(F.lit(1700000000), F.col("o_custkey"), F.col("o_orderkey")).alias("name"))


@query("SELECT c_custkey AS inode, s_acctbal AS saved FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def saved_offset_join(spark, d):
    saved = table(spark, d, "supplier").select(F.col("s_suppkey").alias("inode"), F.col("s_acctbal").alias("saved"))
    return spans.with_saved(table(spark, d, "customer").select(F.col("c_custkey").alias("inode")), saved)


@query("SELECT s_suppkey AS inode, s_acctbal AS saved FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def offset_gc_semi(spark, d):
    live = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("inode"))
    return spans.live_only(table(spark, d, "supplier").select(F.col("s_suppkey").alias("inode"), F.col("s_acctbal").alias("saved")), live)


@query("""SELECT event_id, props AS meta FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS props FROM events)""")
def meta_json(spark, d):
    """A meta template that is JSON for most rows; where it isn't, meta is null."""
    k = F.col("event_id")
    none = F.lit(None).cast("map<string,string>")
    lines = table(spark, d, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit("no json "), "props")).otherwise(F.col("props")).alias("app"), *[F.lit(None).cast("string").alias(c) for c in ("host", "env", "file", "line", "meta")], none.alias("labels"), none.alias("annotations"))
    return meta.Overrides(meta="${line.app}", environment={}).apply(lines).select("event_id", "meta")


@query("SELECT p_partkey, lower(p_brand) AS name, CASE WHEN p_size % 2 = 0 THEN 'reg/' || p_size END AS image FROM part")
def container_image_any_case(spark, d):
    """The image of a container whose name is written in another case; null where no container has the name."""
    one = lambda name, image: F.struct(name.alias("name"), image.alias("image"))
    image = F.concat(F.lit("reg/"), F.col("p_size").cast("string"))
    containers = F.array(one(F.lit("side"), F.lit("x")), one(F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.lit("none")), image))
    return table(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("name"), enrich.container_image(containers, F.lower("p_brand")).alias("image"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '{"Image Name":"' || p_brand || '"}' ELSE '{"Image Name":"' || p_brand || '","Tag":"' || p_size || '"}' END AS meta FROM part""")
def image_meta(spark, d):
    """The image as a line's metadata; without a tag its entry is left out."""
    image = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", enrich.image_meta(image).alias("meta"))


@query("""SELECT user_id % 50 AS namespace, user_id AS pod, arg_max(event_id % 9, event_id) AS containers FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""")
def pod_reflector(spark, d):
    """Pods by a watch's last word on each; an error event stands for a deletion."""
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("apply")
    watch = table(spark, d, "events").select((F.col("user_id") % 50).alias("namespace"), F.col("user_id").alias("pod"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 9).alias("containers"))
    return enrich.reflected(watch)
