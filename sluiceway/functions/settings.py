"""Settings from layers: defaults, then files (YAML or Java properties), then environment and arguments, whose lists add to those below."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from sluiceway.functions.quantities import human_bytes
from sluiceway.functions.regexes import split_list

# What is read, and left out, where nothing is set.
DEFAULT_INCLUDE = ["*.log"]
DEFAULT_EXCLUDE = [
    "/var/log/wtmp",
    "/var/log/btmp",
    "/var/log/utmp",
    "/var/log/wtmpx",
    "/var/log/btmpx",
    "/var/log/utmpx",
    "/var/log/asl/**",
    "/var/log/sa/**",
    "/var/log/sar*",
    "/var/log/tallylog",
    "/var/log/fluentd-buffers/**/*",
    "/var/log/pods/**/*",
]


@dataclass(frozen=True)
class Settings:
    log_dirs: tuple[str, ...] = ("/var/log/",)
    include: tuple[str, ...] = tuple(DEFAULT_INCLUDE)
    exclude: tuple[str, ...] = tuple(DEFAULT_EXCLUDE)
    include_regex: tuple[str, ...] = ()
    exclude_regex: tuple[str, ...] = ()
    line_include: tuple[str, ...] = ()
    line_exclude: tuple[str, ...] = ()
    redact: tuple[str, ...] = ()
    k8s_include: tuple[str, ...] = ()
    k8s_exclude: tuple[str, ...] = ()
    lookback: str = "none"
    body_size: int = 2 * 1024 * 1024
    flush_ms: int = 5000
    retry_base_delay_ms: int = 15000
    retry_disk_limit: int = 0
    tags: tuple[str, ...] = ()
    host: str = ""
    endpoint: str = ""
    hostname: str = ""
    ip: str = ""
    mac: str = ""
    gzip_level: int = 2
    timeout_ms: int = 10_000
    journald_paths: tuple[str, ...] = ()
    extra: Mapping[str, str] = field(default_factory=dict)


def properties(text: str) -> dict[str, str]:
    """Java properties: key = value or key: value, # and ! comments, a backslash continues a line."""
    out = {}
    joined = re.sub(r"(?<!\\)\\\r?\n[ \t]*", "", text)
    for line in joined.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, _, value = (re.split(r"\s*[=:]\s*|\s+", line, maxsplit=1) + ["", ""])[0], None, (re.split(r"\s*[=:]\s*|\s+", line, maxsplit=1) + [""])[1]
            out[key] = value
    return out


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """Environment variables in ${NAME} or ${NAME|default}; unknown ones without default stay."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([^|}]+?)(?:\|([^|}]*?))?\}", lambda m: env.get(m[1], m[0] if m[2] is None else m[2]), text)


def layered(*layers: Mapping[str, object]) -> Settings:
    """Later layers win; lists may be texts with commas, sizes may have units."""
    out, kinds = Settings(), {f.name: f for f in fields(Settings)}
    for layer in layers:
        known, extra = {}, dict(out.extra)
        for key, value in layer.items():
            name = key.lower().replace("-", "_").replace(".", "_")
            if name not in kinds or name == "extra":
                extra[key] = str(value)
            elif isinstance(getattr(out, name), tuple):
                known[name] = tuple(split_list(value) if isinstance(value, str) else value)
            elif isinstance(getattr(out, name), int):
                known[name] = human_bytes(value) if isinstance(value, str) and not value.isdigit() else int(value)
            else:
                known[name] = str(value)
        out = replace(out, **known, extra=extra)
    return out


# Where a configuration file holds each setting.
PLACES = {
    "log_dirs": "log.dirs",
    "include": "log.include.glob",
    "include_regex": "log.include.regex",
    "exclude": "log.exclude.glob",
    "exclude_regex": "log.exclude.regex",
    "line_include": "log.line_inclusion_regex",
    "line_exclude": "log.line_exclusion_regex",
    "redact": "log.line_redact_regex",
    "k8s_include": "log.k8s_metadata_include",
    "k8s_exclude": "log.k8s_metadata_exclude",
    "lookback": "log.lookback",
    "body_size": "http.body_size",
    "flush_ms": "http.flush_duration",
    "retry_base_delay_ms": "http.retry_base_delay_ms",
    "retry_disk_limit": "http.retry_disk_limit",
    "host": "http.host",
    "endpoint": "http.endpoint",
    "gzip_level": "http.gzip_level",
    "timeout_ms": "http.timeout",
    "hostname": "http.params.hostname",
    "ip": "http.params.ip",
    "mac": "http.params.mac",
    "tags": "http.params.tags",
    "journald_paths": "journald.paths",
}
# The options of the command line and the settings that they set; with a prefix and in upper case they are environment variables.
OPTIONS = {
    "logdir": "log_dirs",
    "include": "include",
    "include-regex": "include_regex",
    "exclude": "exclude",
    "exclude-regex": "exclude_regex",
    "line-inclusion": "line_include",
    "line-exclusion": "line_exclude",
    "line-redact": "redact",
    "k8s-metadata-line-inclusion": "k8s_include",
    "k8s-metadata-line-exclusion": "k8s_exclude",
    "lookback": "lookback",
    "ingest-buffer-size": "body_size",
    "flush-duration": "flush_ms",
    "retry-disk-limit": "retry_disk_limit",
    "host": "host",
    "endpoint-path": "endpoint",
    "gzip-level": "gzip_level",
    "ingest-timeout": "timeout_ms",
    "os-hostname": "hostname",
    "ip": "ip",
    "mac-address": "mac",
    "tags": "tags",
    "journald-paths": "journald_paths",
}


def from_yaml(text: str, env: Mapping[str, str] | None = None) -> dict[str, object]:
    """A layer from a YAML file, with ``${VARIABLES}`` put in. What has no setting of its own is named by its place."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("YAML files need a YAML reader; properties, environment and arguments don't") from e

    out: dict[str, object] = {}
    names = {place: name for name, place in PLACES.items()}

    def walk(value: object, place: str) -> None:
        if place in names:
            if value is not None:
                out[names[place]] = [str(x) for x in value] if isinstance(value, list) else value if isinstance(value, int) else str(value)
        elif isinstance(value, Mapping):
            for key, inner in value.items():
                walk(inner, f"{place}.{key}" if place else str(key))
        elif value is not None:
            out[place] = value

    walk(yaml.safe_load(expand(text, env)) or {}, "")
    return out


def from_env(prefix: str, env: Mapping[str, str] | None = None) -> dict[str, object]:
    """A layer from environment variables such as PREFIX_LOGDIR; empty ones count as unset."""
    env = os.environ if env is None else env
    found = {name: env.get(f"{prefix}_{option.upper().replace('-', '_')}") for option, name in OPTIONS.items()}
    return {name: value for name, value in found.items() if value}


def from_arguments(arguments: list[str]) -> dict[str, object]:
    """A layer from a command line; list options may come again and hold commas."""
    import argparse

    lists = {f.name for f in fields(Settings) if isinstance(getattr(Settings(), f.name), tuple)}
    parser = argparse.ArgumentParser(allow_abbrev=False)
    for option, name in OPTIONS.items():
        short = {"logdir": ["-d"], "tags": ["-t"]}.get(option, [])
        parser.add_argument(f"--{option}", *short, dest=name, action="append" if name in lists else "store")
    found = {k: v for k, v in vars(parser.parse_args(arguments)).items() if v is not None}
    return {k: [x for part in v for x in split_list(part)] if isinstance(v, list) else v for k, v in found.items()}


def overridden(settings: Settings, *layers: Mapping[str, object]) -> Settings:
    """Settings with what environment and arguments say: lists are added to, other values replaced."""
    for layer in layers:
        new = layered(layer)
        change = {}
        for f in fields(Settings):
            if f.name in layer and f.name != "extra":
                value = getattr(new, f.name)
                old = getattr(settings, f.name)
                change[f.name] = (*old, *(x for x in value if x not in old)) if isinstance(value, tuple) else value
        settings = replace(settings, **change)
    return settings
