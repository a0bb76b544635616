"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of its n-word
shingles, repeats included (a text of fewer words, but not none, has one shingle of all its words; one without words has
the fingerprint zero). Texts are in one component if a chain of fingerprints leads from one to the other in which
neighbours differ by ``distance`` bits at most.

The bits are split into blocks. Two fingerprints that differ in d bits differ in d blocks at most, so of b blocks they share
b - d or more: for each choice of b - d blocks there is a table that is joined on these blocks' bits. More blocks make more
tables of longer keys; ``blocks_for`` takes the number that costs least for the count of distinct fingerprints, and each
finds all links. Candidates of one bucket are verified by their Hamming distance.

Copies and hot buckets:
- Only distinct fingerprints are compared, whatever share of all rows one has.
- A bucket is compared in chunks of CHUNK fingerprints, each pair of chunks a block of its own, so no task holds
  a bucket. A block gives the edges of a spanning forest of its links, never its pairs.
- Fingerprints go back to their rows by a join that splits hot fingerprints; components join hubs in parts.

Null, empty and blank texts have the fingerprint zero and link like any other. Rows of null or repeated keys are rows of
their own; a component's id is its smallest key that isn't null, or null if it has none. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import batch_rows, cut, numbered, spread_join
from sluiceway.llm.ngram_join import components

N, DISTANCE, SEED = 3, 3, 42
BITS = 64
MOST_BLOCKS = 8
CHUNK = 2048
#: Runs of more fingerprints are compared as a matrix of their own, shorter ones side by side with their neighbours.
LONG_RUN = 64
#: Comparing a pair costs about this share of dealing a row to a table.
PAIR_COST = 1 / 50
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SLICE = 65_536


def fingerprint(text: str | None, n: int = N) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # lower() of bytes changes A-Z alone
    if not words:
        return 0
    k = min(n, len(words))
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(whole[a:z], SEED) for a, z in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), SLICE):  # bounded memory for texts of any length
        ones += np.unpackbits(hashes[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, n: int = N) -> DataFrame:
    """Rows (key, text) to rows (key, fp): the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    return rows.select("key", "text").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint")


def borders(blocks: int) -> list[int]:
    """The first bit of each block, and the end."""
    return [BITS * i // blocks for i in range(blocks + 1)]


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """One mask, as a signed number, for each choice of ``blocks - distance`` blocks."""
    edge = borders(blocks)
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    found = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """The number of blocks that costs least: rows dealt to tables, and pairs of unrelated fingerprints that share a bucket."""

    def cost(blocks: int) -> float:
        tables, shared = comb(blocks, distance), BITS * (blocks - distance) // blocks
        return tables * (count + PAIR_COST * count * count / 2 ** (shared + 1))

    return min(range(distance + 1, max(MOST_BLOCKS, distance + 1) + 1), key=cost)


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of links those that connect what wasn't connected before."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _matrix(fps: np.ndarray, chunk: np.ndarray, across: bool, distance: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a long run (places in it), searched from each place that wasn't met yet: one row of the matrix at a time."""
    left = np.ones(len(fps), bool)
    for first in range(len(fps)):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front:
            at = front.pop()
            near = left & (np.bitwise_count(fps ^ fps[at]) <= distance)
            if across:
                near &= chunk != chunk[at]
            new = np.flatnonzero(near)
            left[new] = False
            for k in new.tolist():
                yield at, k
            front.extend(new.tolist())


def _edges(block: pa.Table, distance: int) -> pa.Table:
    """Edges (a, b) of spanning forests of the links inside each part of a scope. Rows: part, chunk, fp; ``i`` and ``j`` are
    the chunks that are compared, and links of a chunk with itself count where both are the same."""
    out: list[tuple[int, int]] = []
    across = block.num_rows > 0 and block["i"][0].as_py() != block["j"][0].as_py()
    order = np.lexsort((block["value"].to_numpy(), block["tab"].to_numpy()))
    fps, chunk = block["fp"].to_numpy()[order], block["chunk"].to_numpy()[order]
    bits, value, tab = fps.view(np.uint64), block["value"].to_numpy()[order], block["tab"].to_numpy()[order]
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (tab[1:] != tab[:-1])]) if n else np.array([], np.int64)
    lengths = np.diff(np.r_[starts, n])
    for lo, size in zip(starts[lengths > LONG_RUN].tolist(), lengths[lengths > LONG_RUN].tolist(), strict=True):
        run = slice(lo, lo + size)
        out += [(int(fps[lo + x]), int(fps[lo + y])) for x, y in _matrix(bits[run], chunk[run], across, distance)]
    run_of = np.repeat(np.arange(len(starts)), lengths)
    few = np.flatnonzero(np.repeat(lengths <= LONG_RUN, lengths)) if n else np.array([], np.int64)
    links = []
    for d in range(1, int(lengths[lengths <= LONG_RUN].max(initial=0))):  # each row of a short run with the one d places behind
        if len(few) <= d:
            break
        x, y = few[:-d], few[d:]
        same = run_of[x] == run_of[y]
        x, y = x[same], y[same]
        near = np.bitwise_count(bits[x] ^ bits[y]) <= distance
        if across:
            near &= chunk[x] != chunk[y]
        links.append(np.stack([fps[x[near]], fps[y[near]]], axis=1))
    if links:
        out += _forest(map(tuple, np.concatenate(links).tolist()))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


#: About as many rows of small buckets as are compared in one call.
BIN_ROWS = 50_000


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) whose components are those of all links of ``distance`` bits at most."""
    count = fps.count()
    chosen = masks(blocks_for(count, distance), distance)
    placed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in chosen])).alias("tab", "value"))
    placed = placed.withColumn("bucket", F.struct("tab", "value"))
    buckets = cut(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    held = buckets.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    bins = max(1, -(-held // BIN_ROWS))
    member = spread_join(placed.select("bucket", "fp"), buckets, "bucket", "m", count * len(chosen), "fp")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    bucket = [F.col("bucket.tab").alias("tab"), F.col("bucket.value").alias("value")]
    few = member.where(F.col("m") <= CHUNK).select(F.pmod(F.xxhash64("bucket"), F.lit(bins)).cast("string").alias("scope"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chunk"), *bucket, "fp")
    many = member.where(F.col("m") > CHUNK).withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), chunks - 1)))
    many = many.select(F.concat_ws("/", "bucket.tab", "bucket.value").alias("scope"), F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"), "chunk", *bucket, "fp")
    return few.unionByName(many).groupBy("scope", "i", "j").applyInArrow(lambda t: _edges(t, distance), "a bigint, b bigint").distinct()


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, distance: int = DISTANCE) -> DataFrame:
    """Per document: key, fingerprint (16 hex digits), component_id (the smallest key of its component) and n_same (rows of its fingerprint)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    with batch_rows(spark):
        signed = numbered(fingerprints(rows, n), "row")
    known = cut(signed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key")))
    roots = components(cut(links(known.select("fp"), distance))).withColumnRenamed("node", "fp")
    named = known.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    ids = named.groupBy("root").agg(F.min("first_key").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    per_fp = spread_join(named, ids, "root", "fps", known.count(), "fp").select("fp", "n", "component_id")
    out = spread_join(signed, per_fp, "fp", "n", signed.count(), "row")
    return out.select(F.col("key").alias(key), hex_digits(F.col("fp")).alias("fingerprint"), "component_id", F.col("n").alias("n_same"))


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
