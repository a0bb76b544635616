"""``${name}`` and ``${name|default}`` in templates, compiled to Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIABLE = re.compile(r"\$\{([^|}]+?)(?:\|([^|}]*?))?\}")


def substitute(template: str, value: Callable[[str], Column | None]) -> Column:
    """The template with its variables put in; ``value`` gives a name's Column (null rows are unknown) or None.

    An unknown name becomes its default; without one it stays as written. Defaults hold no variables.
    """
    parts, at = [], 0
    for m in VARIABLE.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        instead = F.lit(m[0] if m[2] is None else m[2])
        known = value(m[1])
        parts.append(instead if known is None else F.coalesce(known, instead))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def names(template: str) -> list[str]:
    return [m[1] for m in VARIABLE.finditer(template)]
