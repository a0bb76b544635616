"""N-gram Jaccard join by MinHash banding.

Texts become sets of 64-bit hashes of n consecutive words (a text of fewer words, but not none, has
one shingle of all its words). A MinHash signature of bands x rows values is cut into bands; texts that
agree on a band are candidates; each candidate pair is verified on the full sets. Bands and rows follow
from the threshold and the target recall at it.

Copies and hot groups:
- Buckets, components and copies of one set may hold any share of all rows: joins with them split hot keys.
- Documents of one shingle set are a class. Only one representative of a class is compared; counts of
  links are weighted by class sizes, so copies are never expanded.
- Buckets join into candidate groups (connected components over bucket membership). A group is compared
  in blocks: pairs of chunks of about CHUNK members and CHUNK_SHINGLES shingles at most, each pair of members in one block. Large
  groups whose buckets are much smaller than the group are compared by bucket instead, each pair in the
  first band it shares. Every block is a task's share of work of bounded memory and emits one row for each
  member (its number of links and the root of a spanning forest), never pairs.

Null, empty and blank texts have no shingles: no links, a group of their own. Repeated rows and repeated
keys are rows of their own. An empty table gives an empty result. Other columns are ignored. Ties for a
group's name go to the smallest key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import batch_rows, cut, identified, numbered, of_row, spread_join

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
CHUNK, CHUNK_SHINGLES = 512, 1_000_000
BIN_ROWS = 2000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band can have, and the bands it then takes, to reach the recall at the threshold with ``most`` hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it grows large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ w[i : len(words) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**64, count, np.uint64) | np.uint64(1), rng.integers(0, 2**64, count, np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, in slices of bounded memory."""
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), 1024):
        part = ((s[i : i + 1024, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def signatures(rows: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """Of rows (__f, __i, key, own, text): all but the text, set_id (128-bit hash of its shingle set; null if empty), size (of the set) and one hash for each band."""
    bands, per = bands_and_rows(threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, (a, b) = WordHashes(), _multipliers(bands * per, seed)
        for batch in batches:
            ids, sizes, found = [], [], []
            for t in batch.column(4):
                s = shingles(t.as_py(), n, hashes)
                sizes.append(len(s))
                if not len(s):
                    ids.append(None)
                    found.append(None)
                    continue
                ids.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                sig = signature(s, a, b).reshape(bands, per)
                found.append([xxhash.xxh3_64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(sig)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["__f", "__i", "key", "own", "set_id", "size", "bands"])

    key_type = rows.schema["key"].dataType.simpleString()
    return rows.select("__f", "__i", "key", "own", "text").mapInArrow(run, f"__f bigint, __i bigint, key {key_type}, own string, set_id string, size bigint, bands array<bigint>")


def shingle_sets(rows: DataFrame, n: int = N) -> DataFrame:
    """Rows (rep, text) to rows (rep, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), n, hashes) for t in batch.column(1)]
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["rep", "shingles"])

    return rows.select("rep", "text").mapInArrow(run, "rep bigint, shingles array<bigint>")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) to rows (node, root): the smallest node of each one's component; nodes without edges have no row.

    Alternating large-star and small-star steps; the edges shrink to stars in logarithmically many
    rounds. Each round is written, and what reaches the driver is a count and a checksum. A node that holds
    many edges, as the middle of a star does, is joined in parts.
    """

    def state(of: DataFrame) -> tuple[int, int | None]:
        return tuple(of.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def with_least(of: DataFrame, total: int) -> DataFrame:
        return spread_join(of, of.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "a", "n", total, "b")

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = with_least(large, 2 * before[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut(small)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _chunks(sets: str, shingles: str) -> Column:
    """Into how many chunks a group goes: each has about CHUNK sets and CHUNK_SHINGLES shingles at most."""
    return F.greatest(F.ceil(F.col(sets) / CHUNK), F.ceil(F.col(shingles) / CHUNK_SHINGLES)).cast("int")


def _blocks(reps: DataFrame) -> DataFrame:
    """Representatives (rep, rows, size, bands) that share a band with another, dealt to blocks.

    Columns: scope, i, j (the block), part (the group inside the scope), chunk, band (the band compared
    by, or -1 for all), rep, rows, bands.
    """
    total, bands = reps.agg(F.count(F.lit(1)), F.max(F.size("bands"))).first()
    placed = reps.select("rep", "size", F.posexplode("bands").alias("band", "value")).select("rep", "size", F.struct("band", "value").alias("bucket"))
    buckets = cut(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"), F.min("rep").alias("hub")).where("m > 1"))
    member = cut(spread_join(placed.drop("size"), buckets, "bucket", "m", total * (bands or 0), "rep"))
    groups = cut(components(member.select(F.col("rep").alias("a"), F.col("hub").alias("b"))))
    per_root = groups.join(reps.select(F.col("rep").alias("node"), "size"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    by_bucket = buckets.join(groups.withColumnRenamed("node", "hub"), "hub").groupBy("root").agg(F.sum(F.col("m") * _chunks("m", "s")).alias("bucket_cost"))
    plan = cut(per_root.withColumn("chunks", _chunks("n", "s")).join(by_bucket, "root").withColumn("whole", F.col("n") * F.col("chunks") <= F.col("bucket_cost")))
    held = plan.agg(F.sum("n"), F.sum("s")).first()
    bins = max(1, -(-(held[0] or 0) // BIN_ROWS), -(-(held[1] or 0) // CHUNK_SHINGLES))
    planned = spread_join(groups, plan, "root", "n", held[0] or 0, "node").withColumnRenamed("node", "rep")
    grouped = cut(reps.drop("size").join(planned.select("rep", "root", "chunks", "whole"), "rep"))
    own_chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    keep = ["scope", "i", "j", "part", "chunk", "band", "rep", "rows", "bands"]
    few = grouped.where("whole AND chunks <= 1").select(F.pmod(F.xxhash64("root"), F.lit(bins)).cast("string").alias("scope"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("root").alias("part"), F.lit(0).alias("chunk"), F.lit(-1).alias("band"), "rep", "rows", "bands")
    many = grouped.where("whole AND chunks > 1").withColumn("scope", F.concat(F.lit("g"), F.col("root").cast("string"))).withColumn("band", F.lit(-1))
    loose = grouped.where("NOT whole").select("rep", "rows", "bands").join(member.select("rep", "bucket", _chunks("m", "s").alias("chunks")), "rep")
    loose = loose.withColumn("scope", F.concat_ws("/", "bucket.band", "bucket.value")).withColumn("band", F.col("bucket.band"))
    wide = [d.withColumn("chunk", own_chunk).withColumn("x", others).withColumn("i", F.least("chunk", "x")).withColumn("j", F.greatest("chunk", "x")).withColumn("part", F.lit(-1).cast("bigint")).select(keep) for d in (many, loose)]
    return few.select(keep).unionByName(wide[0]).unionByName(wide[1])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets, by products of 0/1 matrices over slices of the shared shingles."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = rank[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    width = max(256, 4_000_000 // max(n, 1))
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        out += m @ m.T
    return out


def links_of(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: which pairs reach the threshold (never a set with itself)."""
    size = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets).astype(np.float64)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def compare(batch: pa.Table, threshold: float) -> pa.Table:
    """One block: per member its links (in documents, in texts) and the root of its tree in the block's forest."""
    part, chunk = batch["part"].to_numpy(), batch["chunk"].to_numpy()
    ids, rows, band = batch["rep"].to_pylist(), batch["rows"].to_numpy(), batch["band"].to_numpy()
    flat = batch["shingles"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
    sets = [values[ends[k] : ends[k + 1]] for k in range(len(ids))]
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True]) if len(order) else np.array([0])
    across = int(batch["i"][0].as_py()) != int(batch["j"][0].as_py()) if len(ids) else False
    docs, texts, roots = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), list(ids)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        if len(at) < 2:
            continue
        linked = links_of([sets[k] for k in at], threshold)
        if across:
            linked &= chunk[at][:, None] != chunk[at][None, :]
        if band[at[0]] >= 0:  # by bucket: a pair counts in the first band it shares
            hashes = np.array([batch["bands"][int(k)].as_py() for k in at], np.int64)
            for b in range(int(band[at[0]])):
                linked &= hashes[:, b][:, None] != hashes[:, b][None, :]
        docs[at] = linked @ rows[at]
        texts[at] = linked.sum(axis=1)
        name = sorted(range(len(at)), key=lambda k: ids[at[k]])
        seen = np.zeros(len(at), bool)
        for k in name:
            if seen[k]:
                continue
            seen[k], front = True, [k]
            while front:
                roots[at[front[-1]]] = ids[at[k]]
                new = np.flatnonzero(linked[front.pop()] & ~seen)
                seen[new] = True
                front.extend(new.tolist())
    return pa.table({"rep": pa.array(ids, pa.int64()), "doc_links": docs, "text_links": texts, "root": pa.array(roots, pa.int64())})


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document: key, set_id, class_id (the smallest key of its group of linked documents), n_links
    (other documents whose similarity reaches the threshold, copies included), n_text_links (other shingle
    sets that do), n_copies (documents of the same set, itself included)."""
    rows = identified(docs).select("__f", "__i", of_row(key).alias("key"), F.lit(None).cast("string").alias("own"), of_row(text).alias("text"))
    return _groups(rows, n, threshold, recall).drop("__f", "__i", "own", "root").withColumnRenamed("key", key)


def _groups(rows: DataFrame, n: int, threshold: float, recall: float = RECALL) -> DataFrame:
    """Of rows (__f, __i, key, own, text): those of ``near_groups`` with __f, __i, own and ``root``, which names the group."""
    with batch_rows(rows.sparkSession):
        signed = numbered(signatures(rows, n, threshold, recall), "row")
    first = F.min(F.struct("row", "__f", "__i"))
    reps = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(first.alias("r"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = cut(reps.select("set_id", F.col("r.row").alias("rep"), "r.__f", "r.__i", "rows", "first_key", "size", "bands"))
    blocks = cut(_blocks(reps.select("rep", "rows", "size", "bands")))
    wanted = reps.select("rep", "__f", "__i").join(blocks.select("rep").distinct(), "rep")
    sets = shingle_sets(rows.select("__f", "__i", "text").join(wanted.hint("merge"), ["__f", "__i"]), n)
    result = "rep bigint, doc_links bigint, text_links bigint, root bigint"
    with batch_rows(rows.sparkSession):
        found = cut(blocks.hint("merge").join(sets, "rep").groupBy("scope", "i", "j").applyInArrow(lambda t: compare(t, threshold), result))
    links = found.groupBy("rep").agg(F.sum("doc_links").alias("doc_links"), F.sum("text_links").alias("text_links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sets_of = reps.drop("bands", "size", "__f", "__i").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    sets_of = cut(sets_of.withColumn("root", F.coalesce("root", "rep")).fillna(0, ["doc_links", "text_links"]))
    names = sets_of.groupBy("root").agg(F.min("first_key").alias("class_id"), F.count(F.lit(1)).alias("n"))
    known = spread_join(sets_of, names, "root", "n", sets_of.count(), "rep").select("set_id", "root", "class_id", "rows", "doc_links", "text_links")
    out = spread_join(signed.drop("size", "bands"), known, "set_id", "rows", signed.count(), "row", "left")
    return out.select(
        "__f",
        "__i",
        "key",
        "own",
        "set_id",
        "root",
        F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("doc_links", F.lit(0)) + F.coalesce(F.col("rows") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
        F.coalesce("rows", F.lit(1)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row of each group of linked documents: that of the smallest key. Texts without words all stay.

    Rows have identities of their own, so those of null or of repeated keys are told apart. Where several rows of a group
    have its smallest key, or all are null, the digest of the row's columns decides."""
    others = [of_row(c).alias(c) for c in docs.columns if c != text]
    digest = F.md5(F.concat(F.coalesce(of_row(text), F.lit("")), F.to_json(F.struct(*others)))) if others else F.md5(F.coalesce(of_row(text), F.lit("")))
    named = identified(docs)
    groups = cut(_groups(named.select("__f", "__i", of_row(key).alias("key"), digest.alias("own"), of_row(text).alias("text")), n, threshold).select("__f", "__i", "key", "own", "set_id", "root"))
    order = F.struct(F.col("key").isNull().alias("n"), "key", "own", "__f", "__i")
    chosen = groups.where("set_id IS NOT NULL").groupBy("root").agg(F.min(order).alias("w")).select("w.__f", "w.__i")
    stays = chosen.unionByName(groups.where("set_id IS NULL").select("__f", "__i"))
    return named.join(stays, ["__f", "__i"], "left_semi").select("row.*")
