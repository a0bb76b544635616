"""Patterns from configuration, made fit for Spark's regular expressions."""

from __future__ import annotations

import re


def java(pattern: str) -> str:
    """A Perl-style search pattern for RLIKE: Unicode classes, only \\n ends a line, named groups, and $ at the very end only."""
    out = pattern.replace("(?P<", "(?<")
    if out.endswith("$") and (len(out) - len(out[:-1].rstrip("\\")) - 1) % 2 == 0:
        out = out[:-1] + r"\z"
    return "(?dU)" + out


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of them does."""
    return "|".join(f"(?:{java(p)})" for p in patterns)


def glob(pattern: str) -> str:
    """An anchored pattern for a whole path: * and ** cross directories, ? is one character, [!x] negates."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            while pattern[at : at + 1] == "*":
                at += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", at + 1)) > 0:
            inner = pattern[at:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]")
            at = end + 1
        else:
            out.append(re.escape(c) if c not in "/_-" else c)
    return "(?s)^" + "".join(out) + r"\z"


def split_list(text: str) -> list[str]:
    """A comma-separated list; \\, is a comma inside an item, and items are trimmed."""
    return [x for part in re.split(r"(?<!\\),", text) if (x := part.replace("\\,", ",").strip())]
