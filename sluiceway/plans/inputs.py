"""The driver tables seen as lines, pods, spans and samples; each has an SQL twin that states the same in its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.sources.text import split_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: doc_id, n (from 0), line, app, env."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("app"), F.col("lang").alias("env"))
    return split_lines(docs, "text")


LINES = """lines AS (SELECT doc_id, app, env, n - 1 AS n, l[n] AS line FROM (SELECT doc_id, source AS app, lang AS env, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE n < len(l) OR l[n] <> '' OR len(l) = 1)"""


def container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as container lines; every tenth has an ordinary file, every fifteenth none; labels by segment."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pod = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    ns = F.lower(F.replace("n_name", F.lit("_"), F.lit("-")))
    path = F.concat(F.lit("/var/log/containers/"), pod, F.lit("_"), ns, F.lit("_"), F.lower("c_mktsegment"), F.lit("-"), F.sha2(F.col("c_custkey").cast("string"), 256), F.lit(".log"))
    file = F.when(F.col("c_custkey") % 15 == 3, None).when(F.col("c_custkey") % 10 == 7, F.concat(F.lit("/var/log/app"), F.col("c_custkey").cast("string"), F.lit(".log"))).otherwise(path)
    labels = F.when(F.col("c_custkey") % 4 != 0, F.create_map(F.lit("tier"), F.lower("c_mktsegment"), F.lit("zone"), F.concat(F.lit("z"), (F.col("c_nationkey") % 3).cast("string"))))
    annotations = F.when(F.col("c_custkey") % 6 == 0, F.create_map(F.lit("owner"), F.when(F.col("c_custkey") % 12 == 0, F.lit("core")).otherwise("edge")))
    return c.select("c_custkey", file.alias("file"), labels.alias("labels"), annotations.alias("annotations"), F.concat(F.lit("balance "), F.round("c_acctbal").cast("long").cast("string")).alias("line"), F.lower("c_mktsegment").alias("app"))


CONTAINERS = """cl AS (SELECT c_custkey, c_nationkey, lower(c_mktsegment) AS segment, c_acctbal,
CASE WHEN c_custkey % 15 = 3 THEN NULL WHEN c_custkey % 10 = 7 THEN '/var/log/app' || c_custkey || '.log'
ELSE '/var/log/containers/' || lower(replace(c_name, '#', '-')) || '_' || lower(replace(n_name, '_', '-')) || '_' || lower(c_mktsegment) || '-' || sha256(c_custkey::VARCHAR) || '.log' END AS file,
CASE WHEN c_custkey % 4 <> 0 THEN lower(c_mktsegment) END AS tier, CASE WHEN c_custkey % 4 <> 0 THEN 'z' || (c_nationkey % 3) END AS zone,
CASE WHEN c_custkey % 12 = 0 THEN 'core' WHEN c_custkey % 6 = 0 THEN 'edge' END AS owner,
lower(replace(n_name, '_', '-')) AS ns, lower(replace(c_name, '#', '-')) AS pod
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def pod_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known pods: customers but every seventh."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 7 <> 0")
    return c.select(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("namespace"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("pod"), F.concat(F.lit("registry/app:"), F.col("c_custkey").cast("string")).alias("image"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as byte ranges of files: file_id, start, end."""
    start = (F.col("l_partkey") % 40) * 20
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_suppkey") % 8).alias("batch_id"))


SPANS = """sp AS (SELECT l_orderkey AS file_id, (l_partkey % 40) * 20 AS "start", (l_partkey % 40) * 20 + l_quantity::BIGINT AS "end", l_suppkey % 8 AS batch_id FROM lineitem)"""
ISLANDS = """isl AS (SELECT file_id, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, max("end") OVER (PARTITION BY file_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)) GROUP BY file_id, g)"""


def cluster(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as pods of their nation's node, with the segment as container; order counts as states."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    phase = F.element_at(F.array(*map(F.lit, ["Running", "Pending", "succeeded", "Failed", "Evicted"])), (k % 5 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ["running", "waiting", "terminated"])), (k % 3 + 1).cast("int"))
    name = F.lower("c_mktsegment")
    quantities = F.create_map(F.lit("cpu"), F.concat((k % 900).cast("string"), F.lit("m")), F.lit("memory"), F.concat((k % 512).cast("string"), F.lit("Mi")))
    one = F.struct(name.alias("name"), F.concat(F.lit("reg/"), name, F.lit(":v"), (k % 4).cast("string")).alias("image"), quantities.alias("limits"), F.lit(None).cast("map<string,string>").alias("requests"))
    status = F.struct(name.alias("name"), (k % 2 == 0).alias("ready"), (k % 9).cast("int").alias("restarts"), state.alias("state"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("last_state"))
    owner = F.struct(F.concat(F.lit("set-"), (k % 11).cast("string")).alias("name"), F.lit("ReplicaSet").alias("kind"), (k % 3 != 0).alias("controller"))
    condition = F.struct(F.lit("Ready").alias("type"), F.when(k % 4 == 0, "True").otherwise("False").alias("status"))
    pods = c.select(
        F.concat(F.lit("ns"), (k % 6).cast("string")).alias("namespace"), F.concat(F.lit("pod-"), k.cast("string")).alias("name"), F.concat(F.lit("node-"), F.col("c_nationkey").cast("string")).alias("node"),
        phase.alias("phase"), F.array(owner).alias("owners"), F.when(k % 17 != 0, F.array(condition)).alias("conditions"), F.array(one).alias("containers"), F.lit(None).cast("array<struct<name:string,image:string,limits:map<string,string>,requests:map<string,string>>>").alias("init_containers"),
        F.array(status).alias("statuses"), F.lit(None).cast("array<struct<name:string,ready:boolean,restarts:int,state:string,started_at:timestamp,last_state:string>>").alias("init_statuses"),
    )
    usage = c.where("c_custkey % 13 <> 0").select(F.concat(F.lit("ns"), (k % 6).cast("string")).alias("namespace"), F.concat(F.lit("pod-"), k.cast("string")).alias("pod"), name.alias("container"), F.concat((k * 1000).cast("string"), F.lit("u")).alias("cpu"), F.concat(k.cast("string"), F.lit("Ki")).alias("memory"))
    n = F.col("n_nationkey")
    nodes = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("node-"), n.cast("string")).alias("name"), F.lit(None).cast("timestamp").alias("created"), (n % 5 == 0).alias("unschedulable"),
        F.array(F.struct(F.lit("InternalIP").alias("type"), F.concat(F.lit("10.0.0."), n.cast("string")).alias("address"))).alias("addresses"),
        F.create_map(F.lit("cpu"), F.concat((n + 1).cast("string")), F.lit("memory"), F.concat((n + 1).cast("string"), F.lit("Gi")), F.lit("pods"), F.lit("110")).alias("capacity"),
        F.when(n % 6 != 0, F.create_map(F.lit("cpu"), F.concat((n * 900).cast("string"), F.lit("m")), F.lit("memory"), F.concat((n + 1).cast("string"), F.lit("G")))).alias("allocatable"),
        F.array(F.struct(F.lit("Ready").alias("type"), F.when(n % 4 == 1, "False").otherwise("True").alias("status"), F.lit("m").alias("message"), F.lit(None).cast("timestamp").alias("heartbeat"), F.lit(None).cast("timestamp").alias("transition"))).alias("conditions"),
    )
    node_usage = table(spark, sf_dir, "nation").where("n_nationkey % 8 <> 7").select(F.concat(F.lit("node-"), n.cast("string")).alias("node"), F.concat((n * 7).cast("string"), F.lit("m")).alias("cpu"), F.concat((n * 3).cast("string"), F.lit("Mi")).alias("memory"))
    return {"pods": pods, "usage": usage, "nodes": nodes, "node_usage": node_usage}


PODS = """pods AS (SELECT c_custkey AS k, 'ns' || (c_custkey % 6) AS namespace, 'pod-' || c_custkey AS name, 'node-' || c_nationkey AS node, ['Running','Pending','succeeded','Failed','Evicted'][c_custkey % 5 + 1] AS phase,
['running','waiting','terminated'][c_custkey % 3 + 1] AS state, lower(c_mktsegment) AS container, c_custkey % 2 = 0 AS ready,
CASE WHEN c_custkey % 3 <> 0 THEN 'set-' || (c_custkey % 11) ELSE '' END AS controller, CASE WHEN c_custkey % 3 <> 0 THEN 'ReplicaSet' ELSE '' END AS controller_type FROM customer),
vp AS (SELECT * FROM pods WHERE k % 17 <> 0), cr AS (SELECT * FROM vp WHERE k % 13 <> 0)"""
POD_COUNTS = """pc AS (SELECT node, count(*) FILTER (lower(phase) = 'failed') AS pods_failed, count(*) FILTER (lower(phase) = 'pending') AS pods_pending, count(*) FILTER (lower(phase) = 'running') AS pods_running,
count(*) FILTER (lower(phase) = 'succeeded') AS pods_succeeded, count(*) FILTER (lower(phase) NOT IN ('failed','pending','running','succeeded')) AS pods_unknown, count(*) AS pods_total FROM vp GROUP BY node)"""
CONTAINER_COUNTS = """cc AS (SELECT node, 0::BIGINT AS containers_init, count(*) FILTER (ready AND state = 'running') AS containers_ready, count(*) FILTER (state = 'running') AS containers_running,
count(*) FILTER (state = 'terminated') AS containers_terminated, count(*) FILTER (state = 'waiting') AS containers_waiting, count(*) AS containers_total FROM cr GROUP BY node)"""
NODE_ROWS = """nr AS (SELECT 'node-' || n_nationkey AS node, n_nationkey % 5 = 0 AS unschedulable, n_nationkey * 7 AS cpu_usage, n_nationkey * 3 * 1048576 AS memory_usage,
CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey * 900 END AS cpu_allocatable, CASE WHEN n_nationkey % 6 <> 0 THEN (n_nationkey + 1) * 1000000000::BIGINT END AS memory_allocatable,
(n_nationkey + 1) * 1000 AS cpu_capacity, (n_nationkey + 1) * 1073741824::BIGINT AS memory_capacity, 110 AS pods_capacity, n_nationkey % 4 <> 1 AS ready, '10.0.0.' || n_nationkey AS ip,
coalesce(pods_failed, 0) AS pods_failed, coalesce(pods_pending, 0) AS pods_pending, coalesce(pods_running, 0) AS pods_running, coalesce(pods_succeeded, 0) AS pods_succeeded, coalesce(pods_unknown, 0) AS pods_unknown, coalesce(pods_total, 0) AS pods_total,
coalesce(containers_ready, 0) AS containers_ready, coalesce(containers_total, 0) AS containers_total
FROM nation LEFT JOIN pc ON pc.node = 'node-' || n_nationkey LEFT JOIN cc ON cc.node = 'node-' || n_nationkey WHERE n_nationkey % 8 <> 7)"""
