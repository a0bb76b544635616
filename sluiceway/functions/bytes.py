"""Text and bytes at the edges: printable names, query strings, and spans as big-endian numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def printable(text: Column) -> Column:
    """The text without what is no printable ASCII, as a user agent needs it."""
    return F.regexp_replace(text, r"[^\x20-\x7e]", "")


def query_string(params: Mapping[str, Column]) -> Column:
    """``?name=value&..`` of the parameters that are not null, in their order, encoded for a URL."""
    parts = [F.concat(F.lit(name + "="), F.replace(F.url_encode(value.cast("string")), F.lit("+"), F.lit("%20"))) for name, value in params.items()]
    return F.concat(F.lit("?"), F.concat_ws("&", *parts))


def request_params(hostname: Column, now: Column, ip: Column | None = None, mac: Column | None = None, tags: Column | None = None) -> dict[str, Column]:
    """What each request says of its sender: hostname, now (seconds), and ip, mac and tags (an array, joined by commas; none where it is empty) where known."""
    out = {"hostname": hostname, "now": F.floor(now.cast("double"))}
    if ip is not None:
        out["ip"] = ip
    if mac is not None:
        out["mac"] = mac
    if tags is not None:
        out["tags"] = F.when(F.size(tags) > 0, F.array_join(tags, ","))
    return out


def be_u64(value: Column) -> Column:
    """A number as 8 bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def from_be_u64(data: Column) -> Column:
    """The number that the first 8 bytes are; above the signed range it is null."""
    n = F.conv(F.hex(F.substring(data, 1, 8)), 16, 10).try_cast("long")
    return F.when(F.octet_length(data) >= 8, n)


def encode_spans(spans: Column) -> Column:
    """Saved spans: the first one's end, then start and end of each, all big-endian. Null where there are none."""
    parts = F.transform(spans, lambda s: F.concat(be_u64(s["start"]), be_u64(s["end"])))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))
    return F.when(F.size(spans) > 0, F.concat(be_u64(F.get(spans, F.lit(0))["end"]), joined))


def decode_spans(data: Column) -> Column:
    """Spans of saved bytes. 8 bytes alone are an old state: one span from 0 to that number."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    size = F.octet_length(data)
    count = F.floor((size - 8) / 16).cast("int")
    at = lambda i: from_be_u64(F.substring(data, (i * 8 + 1).cast("int"), F.lit(8)))
    many = F.transform(F.sequence(F.lit(0), count - 1), lambda i: span(at(i * 2 + 1), at(i * 2 + 2)))
    return F.when(size == 8, F.array(span(F.lit(0).cast("long"), from_be_u64(data)))).when(size >= 24, many)
