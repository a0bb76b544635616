"""Sharding by rendezvous hashing: every record key goes to the shard with the best score for it.

The score of a shard is -weight / ln(u), u a hash of key and shard in (0, 1): shards get keys in
proportion to their weights, and one more shard takes keys only into itself, since no other score
changes. Places inside a shard come from counts of short runs of rows and a row number inside each
run, so neither a shard's rows nor those of one key meet in one task.

Null keys hash like any other value, to one shard. Null texts have 0 bytes and the checksum of the
empty text. Repeated rows go to one shard, each with a place of its own. An empty table gives an empty
result. Other columns of the caller's table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import numbered, ranked

LAW = "key"


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard (0 to len(weights) - 1) of a key. Weights are positive and may differ."""
    unit = lambda shard: (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scores = [F.struct((-F.lit(float(w)) / F.log(unit(i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return -F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, seed: int = 0) -> DataFrame:
    """Per document: key, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard.

    ``grown_shard`` is the shard with one more shard of the mean weight.
    """
    weights = weights or [1.0] * shards
    known = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("key"), (F.octet_length(known).cast("long") + 16).alias("size"), F.crc32(known.cast("binary")).alias("text_crc32"))
    narrow = numbered(narrow)
    more = [*weights, sum(weights) / len(weights)]
    dealt = narrow.withColumn("law", F.lit(LAW)).withColumn("shard", rendezvous(F.col("key"), weights, seed).cast("int")).withColumn("grown_shard", rendezvous(F.col("key"), more, seed).cast("int"))
    placed = ranked(dealt, ["shard"], ["key", "size", "text_crc32"], narrow.count(), name="slot")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
