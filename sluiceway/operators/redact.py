"""Redaction of all matches of several patterns at once."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.regexes import any_of, java

MARK = "[REDACTED]"


def may_be_empty(pattern: str) -> bool:
    """Whether a pattern may match nothing, such as ``x*`` or ``(?=a)``; unsure patterns may."""
    try:
        return re._parser.parse(pattern).getwidth()[0] == 0  # noqa: SLF001
    except (re.error, AttributeError, RecursionError, OverflowError):
        return True


def finder(pattern: str) -> regex.Pattern:
    """The pattern for the search in Python: $ is the very end, as for Spark's search."""
    if pattern.endswith("$") and (len(pattern) - len(pattern[:-1].rstrip("\\")) - 1) % 2 == 0:
        pattern = pattern[:-1] + r"\Z"
    return regex.compile(pattern)


def cover(line: str, finders: list[regex.Pattern], mark: str) -> str:
    """The line with a mark for each maximal run of matched text, in one pass over the sorted matches. Matches of nothing hide nothing."""
    spans = [(a, b) for f in finders for a, b in (m.span() for m in f.finditer(line)) if a < b]
    if not spans:
        return line
    if len(finders) > 1:
        spans.sort()
    out, at, (start, reach) = [], 0, spans[0]
    for a, b in spans:
        if a > reach:
            out += (line[at:start], mark)
            at, start, reach = reach, a, b
        elif b > reach:
            reach = b
    out += (line[at:start], mark, line[reach:])
    return "".join(out)


#: A class of characters, said by them and by ranges alone, one of them or a run.
CLASS = re.compile(r"(\[[^\]\[\\&^]+\])\+?")


def union_of_classes(patterns: list[str]) -> str | None:
    """The runs of all characters that the patterns match, if each matches characters of a class one by one: their matches touch or lie apart."""
    found = [CLASS.fullmatch(p) for p in patterns]
    return f"[{''.join(m[1] for m in found)}]+" if all(found) else None


def redact(line: Column, patterns: list[str], mark: str = MARK) -> Column:
    """Each maximal run of matched text becomes one mark. All patterns see the text as it was; ranges that
    overlap or touch are one. Lines without any match skip the work, null stays null.

    One pattern whose matches hold something is a replacement of its runs, and so are several classes of characters. Places of several patterns' matches, or of
    matches of nothing, come from an Arrow function, linear in the text and sorted matches; Spark's search picks the lines that it sees.
    """
    if not patterns:
        return line
    runs = union_of_classes(patterns) or (f"(?:{java(patterns[0])})+" if len(patterns) == 1 and not may_be_empty(patterns[0]) else None)
    if runs:
        return F.regexp_replace(line, F.lit(runs), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$")))

    @F.arrow_udf("string")
    def covered(lines: pa.Array) -> pa.Array:
        finders = [finder(p) for p in patterns]
        return pa.array([cover(x, finders, mark) if x is not None else None for x in lines.to_pylist()], pa.string())

    return F.coalesce(covered(F.when(line.rlike(any_of(patterns)), line)), line)


def redact_lines(lines: DataFrame, patterns: list[str], column: str = "line") -> DataFrame:
    return lines.withColumn(column, redact(F.col(column), patterns)) if patterns else lines
