"""Which lines and files pass: line patterns, path rules, and rules on namespaces, pods, labels and annotations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.regexes import any_of, glob
from sluiceway.functions.settings import DEFAULT_EXCLUDE, DEFAULT_INCLUDE


@dataclass(frozen=True)
class LineRules:
    """A line must match any inclusion (if there are some) and no exclusion; lines of null are dropped if rules are set."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def passes(self, line: Column) -> Column | None:
        """None where no rule is set, so that no stage is needed."""
        tests = []
        if self.include:
            tests.append(line.rlike(any_of(list(self.include))))
        if self.exclude:
            tests.append(~line.rlike(any_of(list(self.exclude))))
        if not tests:
            return None
        out = line.isNotNull()
        for t in tests:
            out = out & t
        return out

    def apply(self, lines: DataFrame, column: str = "line") -> DataFrame:
        test = self.passes(F.col(column))
        return lines if test is None else lines.where(test)


@dataclass(frozen=True)
class PathRules:
    """A path must match an inclusion, of which there must be some, and no exclusion. Globs hold for whole paths, regexes search."""

    include: tuple[str, ...] = tuple(DEFAULT_INCLUDE)
    exclude: tuple[str, ...] = tuple(DEFAULT_EXCLUDE)
    include_regex: tuple[str, ...] = ()
    exclude_regex: tuple[str, ...] = ()

    @staticmethod
    def _any(path: Column, globs: tuple[str, ...], regexes: tuple[str, ...]) -> Column:
        patterns = [glob(g) for g in globs] + [f"(?:{any_of([r])})" for r in regexes]
        return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)

    def included(self, path: Column) -> Column:
        return self._any(path, self.include, self.include_regex)

    def excluded(self, path: Column) -> Column:
        return self._any(path, self.exclude, self.exclude_regex)

    def status(self, path: Column) -> Column:
        return F.when(~self.included(path), "not_included").when(self.excluded(path), "excluded").otherwise("ok")

    def passes(self, path: Column) -> Column:
        return self.included(path) & ~self.excluded(path)

    def excludes_all(self, folder: Column) -> Column:
        """Whether the exclusions surely hold for all paths below a directory: globs that end in ``*``, and regexes that can't depend on what follows."""
        open_ended = tuple(r for r in self.exclude_regex if not re.search(r"[$]|\\[zZbB]|[(][?]", r))
        return self._any(F.concat(folder, F.lit("/")), tuple(g for g in self.exclude if g.endswith("*")), open_ended)

    @classmethod
    def of_dirs(cls, dirs: list[str]) -> PathRules:
        """Rules for what lies in the given directories, themselves included."""
        stems = [d.rstrip("/") for d in dirs]
        return cls(tuple(x for d, s in zip(dirs, stems, strict=True) for x in (f"{s}/*", d)), ())


def is_target(path: Column, is_dir: Column, dirs: PathRules, master: PathRules) -> Column:
    """Paths inside the watched directories that pass the file rules or are directories."""
    return dirs.passes(path) & (master.passes(path) | F.coalesce(is_dir, F.lit(False)))


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _leading_value(text: str) -> str:
    """What a value holds at most: lower-case letters and digits, and single hyphens that have one of these behind them."""
    end = 0
    while end < len(text) and (_alnum(text[end]) or text[end] == "-" and end + 1 < len(text) and _alnum(text[end + 1])):
        end += 1
    return text[:end]


@dataclass(frozen=True)
class K8sRules:
    """Rules ``namespace:x``, ``name:x``, ``label.k:v`` and ``annotation.k:v``; names and values end at the first character that they can't hold."""

    namespaces: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    labels: tuple[tuple[str, str], ...] = ()
    annotations: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, rules: list[str]) -> K8sRules:
        found: dict[str, list] = {"namespace": [], "name": [], "label": [], "annotation": []}
        for rule in rules:
            for kind in ("namespace", "name"):
                if rule.startswith(kind + ":"):
                    found[kind].append(_leading_value(rule[len(kind) + 1 :]))
            for kind in ("label", "annotation"):
                key, colon, value = rule[len(kind) + 1 :].partition(":")
                if rule.startswith(kind) and colon and key and _alnum(key[0]) and "\n" not in key:
                    found[kind].append((key, _leading_value(value)))
        return cls(*[tuple(x) for x in found.values()])


# The paths of container logs of a namespace and of a pod, whose name comes in place of NAME.
IN_NAMESPACE = r"/([a-z0-9A-Z\-.]+)_NAME_([a-z0-9A-Z\-.]+)-([a-z0-9]{64}).log$"
OF_POD = r"/NAME_([a-z0-9A-Z\-.]+)_([a-z0-9A-Z\-.]+)-([a-z0-9]{64}).log$"


def _file_test(file: Column, namespaces: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> Column:
    patterns = [IN_NAMESPACE.replace("NAME", re.escape(x)) for x in namespaces] + [OF_POD.replace("NAME", re.escape(x)) for x in names]
    return file.rlike(any_of(patterns))


def _by_key(pairs: tuple[tuple[str, str], ...]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for k, v in pairs:
        out.setdefault(k, []).append(v)
    return out


def _wrong(entries: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Whether an entry has a ruled key with another value than the rules'."""
    tests = [(e := F.element_at(entries, k)).isNotNull() & ~e.isin(*vs) for k, vs in _by_key(pairs).items()]
    return _or(tests)


def _hit(entries: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return _or([F.coalesce(F.element_at(entries, k).isin(*vs), F.lit(False)) for k, vs in _by_key(pairs).items()])


def _or(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def k8s_passes(include: K8sRules, exclude: K8sRules, file: Column, labels: Column, annotations: Column) -> Column:
    """Lines without a file pass. An inclusion on labels or annotations only rejects a key with another value; lines without the key pass."""
    ok = F.lit(True)
    if include.namespaces:
        ok = ok & _file_test(file, namespaces=include.namespaces)
    if include.names:
        ok = ok & _file_test(file, names=include.names)
    ok = ok & ~_wrong(labels, include.labels) & ~_wrong(annotations, include.annotations)
    if exclude.namespaces or exclude.names:
        ok = ok & ~_file_test(file, exclude.namespaces, exclude.names)
    ok = ok & ~_hit(labels, exclude.labels) & ~_hit(annotations, exclude.annotations)
    return file.isNull() | ok


def stale(record_ts: Column, now: Column, seconds: int = 30) -> Column:
    return (now.cast("double") - record_ts.cast("double")) >= seconds


def lease_expired(renew: Column, duration_seconds: Column, now: Column) -> Column:
    """Never renewed leases have not expired."""
    return F.coalesce(now > F.timestamp_add("SECOND", duration_seconds, renew), F.lit(False))


def retry_due(name: Column, now_epoch: Column, base_delay: int) -> Column:
    """Retry files ``<epoch>_<id>.retry`` of a sufficient age."""
    return name.endswith(".retry") & F.coalesce(now_epoch - F.split(name, "_")[0].try_cast("long") >= base_delay, F.lit(False))
