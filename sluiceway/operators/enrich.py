"""Container paths, the pod dimension, and lookups of lines in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The path of a container's log, and the directory of these.
CONTAINER_PATH = r"^/var/log/containers/([a-z0-9A-Z\-.]+)_([a-z0-9A-Z\-.]+)_([a-z0-9A-Z\-.]+)-([a-z0-9]{64})\.log$"
CONTAINER_DIR = "/var/log/containers/"


def parse_container_path(file: Column) -> Column:
    """struct(pod, namespace, container) of a container's log path; null for other paths."""
    part = lambda n: F.regexp_extract(file, CONTAINER_PATH, n)
    return F.when(file.rlike(CONTAINER_PATH), F.struct(part(1).alias("pod"), part(2).alias("namespace"), part(3).alias("container")))


def with_container(lines: DataFrame, file: str = "file") -> DataFrame:
    parsed = parse_container_path(F.col(file))
    return lines.withColumns({"pod": parsed["pod"], "namespace": parsed["namespace"], "container": parsed["container"]})


def with_pods(lines: DataFrame, pods: DataFrame) -> DataFrame:
    """Lines (with pod and namespace) and their pod's columns; lines without a known pod pass with nulls.

    ``pods`` has one row for each (namespace, pod); Spark broadcasts it if its size allows.
    """
    return lines.join(pods, ["namespace", "pod"], "left")


def missing_pods(lines: DataFrame, pods: DataFrame) -> DataFrame:
    """Container lines whose pod is not known yet: these wait."""
    return lines.where("pod IS NOT NULL").join(pods.select("namespace", "pod"), ["namespace", "pod"], "left_anti")


def ready_pods(lines: DataFrame, pods: DataFrame) -> DataFrame:
    return lines.join(pods.select("namespace", "pod"), ["namespace", "pod"], "left_semi")


def split_image(image: Column) -> tuple[Column, Column]:
    """(image, tag) at the first colon; a registry's port splits there too. Without a colon the tag is null."""
    at = F.instr(image, ":")
    return F.when(at > 0, F.substring(image, F.lit(1), at - 1)).otherwise(image), F.when(at > 0, F.substring(image, at + 1, F.length(image)))


def container_image(containers: Column, name: Column) -> Column:
    """The image of the container of that name, in any case."""
    return F.get(F.filter(containers, lambda c: F.lower(c["name"]) == F.lower(name)), F.lit(0))["image"]


def image_meta(image: Column) -> Column:
    """{"Image Name": .., "Tag": ..} without null entries."""
    name, tag = split_image(image)
    return F.to_json(F.struct(name.alias("Image Name"), tag.alias("Tag")))


def released_pods(deleted: DataFrame, open_files: DataFrame) -> DataFrame:
    """Deleted pods (namespace, pod) of which no file is open any more: only these may be forgotten."""
    return deleted.join(open_files.select("namespace", "pod").distinct(), ["namespace", "pod"], "left_anti")


def fan_out(lines: DataFrame, paths: str = "paths") -> DataFrame:
    """One line for each path under which its file is watched."""
    return lines.withColumn("file", F.explode(paths)).drop(paths)


def reflected(watch: DataFrame, keys: tuple[str, ...] = ("namespace", "pod"), order: str = "seq", kind: str = "kind") -> DataFrame:
    """The pod dimension that a watch leads to: of each pod what its last event says, without those that were deleted.

    Events may come again: the last by ``order`` counts. One aggregation, combined before it is shuffled."""
    others = [c for c in watch.columns if c not in keys]
    last = watch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("__last"))
    return last.where(f"__last.`{kind}` <> 'delete'").select(*keys, "__last.*").drop(order, kind)
