"""Cluster quantities and sizes as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _letters(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^\p{L}]", "")


def cpu_milli(raw: Column, strict: bool = False) -> Column:
    """Thousandths of a core, rounded up; null if empty, without digits or of an unknown unit.

    All digits count as one number, so '1.5' is 15 cores; ``strict`` reads decimals as they are meant.
    """
    digits = F.regexp_replace(raw, "[^0-9.]", "") if strict else _digits(raw)
    value, unit = F.when(digits.rlike("^[0-9]+([.][0-9]+)?$"), digits).cast("double"), _letters(raw)
    scaled = F.when((value < 1) & F.lit(not strict) | (unit == ""), value * 1000).when(unit == "m", value).when(unit == "u", value / 1000).when(unit == "n", value / 1000000)
    return F.when((raw == "") | (digits == ""), None).otherwise(F.ceil(scaled)).cast("long")


#: Bytes by unit, in lower case.
MEMORY_UNITS = {"": 1, "ki": 1024, "mi": 1024**2, "gi": 1024**3, "ti": 1024**4, "k": 1000, "m": 1000**2, "g": 1000**3}


def memory_bytes(raw: Column, strict: bool = False) -> Column:
    """Bytes; null if empty or without digits. Unknown units count as ki (``strict``: null)."""
    digits, unit = _digits(raw), F.lower(_letters(raw))
    factor = F.lit(None).cast("long") if strict else F.lit(1024).cast("long")
    for name, size in reversed(MEMORY_UNITS.items()):
        factor = F.when(unit == name, F.lit(size).cast("long")).otherwise(factor)
    return F.when((raw == "") | (digits == ""), None).otherwise(digits.cast("long") * factor)


def human_bytes(text: str) -> int:
    """'10 MB' or '2KiB' in bytes, for settings."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([kKmMgGtT]?)(i?)[bB]?\s*", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * (1024 if m[3] else 1000) ** " kmgt".index(m[2].lower() or " "))


def human_duration(seconds: Column) -> Column:
    """Whole seconds as '1day 2h 3m 4s': years (365.25 days), months (30.44 days), days, hours, minutes, seconds; zero parts are left out."""
    parts, left = [], seconds.cast("long")
    for name, plural, size in (("year", "years", 31557600), ("month", "months", 2630016), ("day", "days", 86400), ("h", "h", 3600), ("m", "m", 60), ("s", "s", 1)):
        n = F.floor(left / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, name).otherwise(plural))))
        left = left - n * size
    return F.concat_ws(" ", *parts)
