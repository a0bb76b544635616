"""Field overrides: templates for app, host, env, file and meta, and entries for labels and annotations."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.templates import substitute
from sluiceway.operators.enrich import CONTAINER_DIR

# Fixed value: a container runtime's line: time, stream, partial or full, text.
CRIO = r"([0-9]{4}(?:-[0-9]{2}){2}T(?:[0-9]{2}:){2}[0-9]{2}.[0-9]{1,9}(?:[+-][0-9]{2}:[0-9]{2}|Z)) (stdout|stderr) ([PF]) (.*)"


def is_k8s_line(file: Column, labels: Column, annotations: Column) -> Column:
    return labels.isNotNull() | annotations.isNotNull() | F.coalesce(file.startswith(CONTAINER_DIR), F.lit(False))


def merge_map(base: Column, over: Column) -> Column:
    """``over`` wins; its empty values delete their keys, empty values of ``base`` stay."""
    keys = F.map_keys(over)
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(keys, k))
    return F.map_concat(kept, F.map_filter(over, lambda k, v: v != ""))


def strip_runtime_prefix(line: Column) -> Column:
    """The text of a container runtime's line; other lines as they are."""
    return F.when(line.rlike(CRIO), F.regexp_extract(line, CRIO, 4)).otherwise(line)


@dataclass(frozen=True)
class Overrides:
    """Templates know ``env.X``, ``annot.X``, ``label.X`` and ``line.app|host|env|file`` (as they were before overrides).

    Order: annotations, labels, app, host, env, file, k8s_file (container lines only, and it strips the
    runtime's prefix), meta. ``strict_meta`` fails on meta that isn't JSON; else such meta becomes null.
    """

    app: str | None = None
    host: str | None = None
    env: str | None = None
    file: str | None = None
    k8s_file: str | None = None
    meta: str | None = None
    annotations: Mapping[str, str] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=dict)
    strict_meta: bool = False
    environment: Mapping[str, str] | None = None

    def apply(self, lines: DataFrame) -> DataFrame:
        names = ("app", "host", "env", "file", "k8s_file", "meta", "annotations", "labels")
        if not any(getattr(self, n) for n in names):
            return lines
        environment = os.environ if self.environment is None else self.environment
        old = {n: F.col(f"__{n}") for n in ("app", "host", "env", "file")}

        def value(name: str) -> Column | None:
            kind, _, key = name.partition(".")
            if kind == "env":
                return F.lit(environment[key]) if key in environment else None
            if kind == "annot":
                return F.element_at("annotations", F.lit(key))
            if kind == "label":
                return F.element_at("labels", F.lit(key))
            return old.get(key) if kind == "line" else None

        out = lines.withColumns({f"__{n}": F.col(n) for n in old} | {"__k8s": is_k8s_line(F.col("file"), F.col("labels"), F.col("annotations")), "__annotations": F.col("annotations"), "__labels": F.col("labels")})
        for n in ("annotations", "labels"):
            if over := getattr(self, n):
                entries = F.create_map(*[x for k, v in over.items() for x in (F.lit(k), substitute(v, value))])
                out = out.withColumn(f"__{n}", F.when(F.col("__k8s"), merge_map(F.col(n), entries)).otherwise(F.col(n)))
        for n in ("app", "host", "env"):
            if t := getattr(self, n):
                out = out.withColumn(n, substitute(t, value))
        if self.file:
            out = out.withColumn("file", F.when(~F.col("__k8s") | F.lit(self.k8s_file is None), substitute(self.file, value)).otherwise(F.col("file")))
        if self.k8s_file:
            out = out.withColumn("file", F.when(F.col("__k8s"), substitute(self.k8s_file, value)).otherwise(F.col("file")))
            out = out.withColumn("line", F.when(F.col("__k8s"), strip_runtime_prefix(F.col("line"))).otherwise(F.col("line")))
        if self.meta:
            made = substitute(self.meta, value)
            parse = F.parse_json if self.strict_meta else F.try_parse_json
            out = out.withColumn("meta", F.to_json(parse(made)))
        out = out.withColumns({"annotations": F.col("__annotations"), "labels": F.col("__labels")})
        return out.drop("__k8s", "__annotations", "__labels", *[f"__{n}" for n in old])


def omit_empty(lines: DataFrame, names: tuple[str, ...] = ("app", "host", "env", "level")) -> DataFrame:
    """Empty optional fields are left out, that is null."""
    return lines.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in names})
