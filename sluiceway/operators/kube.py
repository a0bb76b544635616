"""The cluster usage report: containers, nodes and the cluster, from snapshots of pods, nodes and their usage.

Inputs have the schemas PODS and NODES; usage tables are (container, cpu, memory), or with namespace and
pod, and (node, cpu, memory). ``now`` is a Column, so that reports can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.quantities import cpu_milli, memory_bytes
from sluiceway.operators.enrich import split_image


def count_when(test: Column) -> Column:
    return F.coalesce(F.count_if(test), F.lit(0))


def pods_by_node(pods: DataFrame, node: str = "node", phase: str = "phase") -> DataFrame:
    """Pods of each node by phase, in any case; other phases are unknown."""
    p, known = F.lower(phase), ("failed", "pending", "running", "succeeded")
    return pods.groupBy(node).agg(*[count_when(p == x).alias(f"pods_{x}") for x in known], count_when(p.isNull() | ~p.isin(*known)).alias("pods_unknown"), F.count(F.lit(1)).alias("pods_total"))


def containers_by_node(containers: DataFrame, node: str = "node", state: str = "state", ready: str = "ready", init: str = "init") -> DataFrame:
    """Containers of each node by state; ready ones count while running; other states are in no total."""
    s = F.lower(state)
    return containers.groupBy(node).agg(
        count_when(F.col(init)).alias("containers_init"),
        count_when(F.col(ready) & (s == "running")).alias("containers_ready"),
        *[count_when(s == x).alias(f"containers_{x}") for x in ("running", "terminated", "waiting")],
        count_when(s.isin("running", "terminated", "waiting")).alias("containers_total"),
    )


def valid_pods(pods: DataFrame) -> DataFrame:
    """Pods with conditions and container states, and their controller: the first owner that controls."""
    owner = F.get(F.filter("owners", lambda o: o["controller"]), F.lit(0))
    return pods.where("conditions IS NOT NULL AND statuses IS NOT NULL").withColumns({"controller": F.coalesce(owner["name"], F.lit("")), "controller_type": F.coalesce(owner["kind"], F.lit(""))})


def controllers(pods: DataFrame) -> DataFrame:
    """Per (namespace, controller_type, controller): pods and containers, in total and ready; init containers count."""
    ready = F.exists("conditions", lambda c: (F.lower(c["type"]) == "ready") & (F.lower(c["status"]) == "true"))
    states = F.concat("statuses", F.coalesce("init_statuses", F.filter("statuses", lambda s: F.lit(False))))
    return pods.groupBy("namespace", "controller_type", "controller").agg(
        F.count(F.lit(1)).alias("pods_total"),
        count_when(ready).alias("pods_ready"),
        F.sum(F.size(states)).cast("long").alias("containers_total"),
        F.sum(F.size(F.filter(states, lambda s: s["ready"]))).cast("long").alias("containers_ready"),
    )


def container_rows(pods: DataFrame, usage: DataFrame, by_name_only: bool = False, now: Column | None = None) -> DataFrame:
    """One row for each container (init ones included) that has name, image, a state and usage.

    Usage joins by (namespace, pod, container), or by container name alone (the last row by
    ``ts`` or, without it, the greatest wins) where ``by_name_only``.
    """
    now = F.current_timestamp() if now is None else now
    tag = lambda c, init: F.transform(F.coalesce(c, F.filter("containers", lambda x: F.lit(False))), lambda x: F.struct(x.alias("c"), F.lit(init).alias("init")))
    rows = pods.withColumn("__c", F.explode(F.concat(tag(F.col("containers"), False), tag(F.col("init_containers"), True))))
    states = F.concat("statuses", F.coalesce("init_statuses", F.filter("statuses", lambda s: F.lit(False))))
    rows = rows.withColumn("__s", F.try_element_at(F.filter(states, lambda s: s["name"] == F.col("__c.c.name")), F.lit(-1)))
    rows = rows.where("__c.c.name <> '' AND __c.c.image IS NOT NULL AND __s IS NOT NULL").withColumn("container", F.col("__c.c.name"))
    if by_name_only:
        latest = F.max_by(F.struct("cpu", "memory"), F.col("ts")) if "ts" in usage.columns else F.max(F.struct("cpu", "memory"))
        rows = rows.join(usage.groupBy("container").agg(latest.alias("__u")), "container")
    else:
        keyed = usage.select("namespace", F.col("pod").alias("name"), "container", F.struct("cpu", "memory").alias("__u"))
        rows = rows.join(keyed, ["namespace", "name", "container"])
    image, image_tag = split_image(F.col("__c.c.image"))
    state = F.when(F.lower("__s.state").isin("running", "terminated"), F.initcap("__s.state")).otherwise("Waiting")
    limits, requests = F.col("__c.c.limits"), F.col("__c.c.requests")
    last = F.coalesce("__s.last_state", F.lit(""))
    started = F.when(state == "Running", F.col("__s.started_at"))
    return rows.select(
        "namespace", "name", "node", "phase", "controller", "controller_type", "container",
        F.col("__c.init").alias("init"), image.alias("image"), F.coalesce(image_tag, F.lit("")).alias("image_tag"), state.alias("state"),
        F.when(F.lower(last) == F.lower(state), "").otherwise(last).alias("last_state"), F.col("__s.ready").alias("ready"), F.col("__s.restarts").alias("restarts"),
        cpu_milli(F.col("__u.cpu")).alias("cpu_usage"), memory_bytes(F.col("__u.memory")).alias("memory_usage"),
        cpu_milli(F.element_at(limits, "cpu")).alias("cpu_limit"), memory_bytes(F.element_at(limits, "memory")).alias("memory_limit"),
        cpu_milli(F.element_at(requests, "cpu")).alias("cpu_request"), memory_bytes(F.element_at(requests, "memory")).alias("memory_request"),
        F.coalesce(F.unix_millis(started), F.lit(0)).alias("started"), F.coalesce(F.unix_millis(now) - F.unix_millis(started), F.lit(0)).alias("container_age"),
    )


def container_report(pods: DataFrame, usage: DataFrame, by_name_only: bool = False, now: Column | None = None) -> DataFrame:
    """Container rows with their controller's counts (0 where it has none)."""
    counts = controllers(valid_pods(pods))
    renamed = counts.select("namespace", "controller_type", "controller", *[F.col(c).alias(f"controller_{c}") for c in ("pods_total", "pods_ready", "containers_total", "containers_ready")])
    rows = container_rows(valid_pods(pods), usage, by_name_only, now).join(renamed, ["namespace", "controller_type", "controller"], "left")
    return rows.fillna(0, [c for c in rows.columns if c.startswith("controller_") and c.endswith(("total", "ready"))])


NODE_COUNTS = [f"pods_{x}" for x in ("failed", "pending", "running", "succeeded", "unknown", "total")] + [f"containers_{x}" for x in ("init", "ready", "running", "terminated", "waiting", "total")]
NODE_AMOUNTS = ["cpu_usage", "memory_usage", "cpu_allocatable", "cpu_capacity", "memory_allocatable", "memory_capacity", "pods_allocatable", "pods_capacity"]


def node_report(nodes: DataFrame, usage: DataFrame, pods: DataFrame, containers: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each node with usage; of several matching conditions or addresses the last counts."""
    now = F.current_timestamp() if now is None else now
    last = lambda xs, test: F.try_element_at(F.filter(xs, test), F.lit(-1))
    ready = last("conditions", lambda c: F.lower(c["type"]) == "ready")
    address = lambda kind: F.coalesce(last("addresses", lambda a: F.lower(a["type"]) == kind)["address"], F.lit(""))
    amount = lambda m, k, f: f(F.element_at(m, F.lit(k)))
    rows = nodes.join(usage.withColumnRenamed("node", "name").withColumnsRenamed({"cpu": "__cpu", "memory": "__memory"}), "name")
    rows = rows.join(pods_by_node(pods).withColumnRenamed("node", "name"), "name", "left").join(containers_by_node(containers).withColumnRenamed("node", "name"), "name", "left").fillna(0, NODE_COUNTS)
    whole = lambda x: x.try_cast("long")
    out = {
        "cpu_usage": cpu_milli(F.col("__cpu")), "memory_usage": memory_bytes(F.col("__memory")),
        **{f"{k}_{m}": amount(m, k, f) for m in ("allocatable", "capacity") for k, f in (("cpu", cpu_milli), ("memory", memory_bytes), ("pods", whole))},
        "ip": address("internalip"), "ip_external": address("externalip"),
        "ready": F.lower(ready["status"]) == "true", "ready_status": F.coalesce(ready["status"], F.lit("")), "ready_message": F.coalesce(ready["message"], F.lit("")),
        "ready_heartbeat_time": F.coalesce(F.unix_millis(ready["heartbeat"]), F.lit(0)), "ready_transition_time": F.coalesce(F.unix_millis(ready["transition"]), F.lit(0)),
        "ready_heartbeat_age": F.coalesce(F.unix_millis(now) - F.unix_millis(ready["heartbeat"]), F.lit(0)),
        "created_ms": F.coalesce(F.unix_millis("created"), F.lit(0)), "age": F.coalesce(F.unix_millis(now) - F.unix_millis("created"), F.lit(0)),
    }
    return rows.withColumns(out).select(F.col("name").alias("node"), "unschedulable", *out, *NODE_COUNTS)


def cluster_report(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """One row of sums over node rows. Amounts that are null count as nothing; with ``order``, sums restart behind
    a null as a running total of optional values does, in that column's order."""
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in NODE_COUNTS if c in nodes.columns]
    flags = [count_when(F.col("ready")).alias("nodes_ready"), count_when(~F.coalesce("ready", F.lit(False))).alias("nodes_notready"), count_when(F.col("unschedulable")).alias("nodes_unschedulable"), F.count(F.lit(1)).alias("nodes_total")]
    amounts = [c for c in NODE_AMOUNTS if c in nodes.columns]
    if order is None:
        return nodes.agg(*counts, *flags, *[F.sum(c).alias(c) for c in amounts])
    rows = nodes.agg(*counts, *flags, F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *amounts))).alias("__rows"))
    fold = lambda c: F.aggregate("__rows", F.lit(None).cast("long"), lambda acc, x: F.when(acc.isNull(), x[c].cast("long")).otherwise(acc + x[c]))
    return rows.withColumns({c: fold(c) for c in amounts}).drop("__rows")


def as_lines(rows: DataFrame, resource: str, file: str = "reporter") -> DataFrame:
    """Report rows as lines: {"kube": {...}}, without null entries."""
    body = F.to_json(F.struct(F.struct(F.lit(resource).alias("resource"), F.lit("metric").alias("type"), *rows.columns).alias("kube")))
    return rows.select(body.alias("line"), F.lit(file).alias("file"))
