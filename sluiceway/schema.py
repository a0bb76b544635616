"""Fixed schemas: the line relation and the cluster snapshots. Readers state them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.ArrayType(SPAN)
TEXT_MAP = T.MapType(T.StringType(), T.StringType())

LINE = T.StructType(
    [
        T.StructField("line", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("app", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("env", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("annotations", TEXT_MAP),
        T.StructField("labels", TEXT_MAP),
        T.StructField("meta", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("span", SPAN),
        T.StructField("source_kind", T.StringType()),
    ]
)

PODS = """namespace string, name string, node string, phase string, start_time timestamp, pod_ip string, qos_class string,
priority int, priority_class string, owners array<struct<name:string,kind:string,controller:boolean>>,
conditions array<struct<type:string,status:string>>,
containers array<struct<name:string,image:string,limits:map<string,string>,requests:map<string,string>>>,
init_containers array<struct<name:string,image:string,limits:map<string,string>,requests:map<string,string>>>,
statuses array<struct<name:string,ready:boolean,restarts:int,state:string,started_at:timestamp,last_state:string>>,
init_statuses array<struct<name:string,ready:boolean,restarts:int,state:string,started_at:timestamp,last_state:string>>"""

NODES = """name string, created timestamp, unschedulable boolean, addresses array<struct<type:string,address:string>>,
capacity map<string,string>, allocatable map<string,string>,
conditions array<struct<type:string,status:string,message:string,heartbeat:timestamp,transition:timestamp>>"""

EVENTS = """type string, action string, reason string, message string, count int, host string, component string,
obj_kind string, obj_name string, obj_namespace string, field_path string,
first_ts timestamp, last_ts timestamp, event_ts timestamp, creation_ts timestamp, seq bigint"""
