"""Token ids in binary files, with keyed access by a minimal perfect hash.

Files: the documents in ascending order of their integer keys (null first; repeated keys by a hash of the text) are cut into shards of about
``docs_per_shard`` documents, also inside the records of one key. Shard n is ``NNNNNN.ids``, its documents' ids as little-endian unsigned 16- or 32-bit
numbers, nothing between, each document ending with the end id; and ``NNNNNN.idx``, an index: the levels of a
minimal perfect hash over the distinct keys (each level a bit array; a key rests at the first level
where no other key has its bit; the rank of its bit is its number), and for each number a 32-bit fingerprint of
the key, its first record and its record count, for each record where its ids begin, and how many records have no key: these come first. A lookup is a few
hashes and one read. Keys that were not stored are known by their fingerprints, but for 1 in 2^32.

Tasks write to a name of their own and rename when whole, so a task that runs again, or twice, leaves the same
file. What reaches the driver is one row for each shard, MOST_SHARDS at most: its first and last key and its counts.

Null texts are empty: the end id alone. Repeated keys are records of one key. An empty table
gives no shard and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.bpe import default_tokenizer, encoder_for
from sluiceway.llm.common import batch_rows, cut, shared_dir

DOCS_PER_SHARD = 8000
END_ID = 2
GAMMA = 2


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n-1, without the keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # booleans
        self.ranks, done = [], 0
        for bits in levels:
            self.ranks.append(done + np.cumsum(bits) - bits)
            done += int(bits.sum())
        self.size = done

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            width = max(64, GAMMA * len(left))
            at = (mix(left, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 for some of those that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for n, bits in enumerate(self.levels):
            at = (mix(keys[todo], n) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[todo[here]] = self.ranks[n][at[here]]
            todo = todo[~here]
        return out


class Index:
    """A shard's index: records without a key first, then those of keys."""

    def __init__(self, table: PerfectHash, prints: np.ndarray, first: np.ndarray, count: np.ndarray, begins: np.ndarray, nulls: int):
        self.table, self.prints, self.first, self.count, self.begins, self.nulls = table, prints, first, count, begins, nulls

    @classmethod
    def build(cls, keys: list[int | None], begins: np.ndarray) -> Index:
        """Of records' keys in ascending order, null first, and the records' begins (one more than records)."""
        nulls = sum(k is None for k in keys)
        own, first, count = np.unique(np.array(keys[nulls:], np.int64), return_index=True, return_counts=True)
        table = PerfectHash.build(own)
        at = table.number(own)
        prints, firsts, counts = (np.zeros(len(own), t) for t in (np.uint32, np.int64, np.int64))
        prints[at], firsts[at], counts[at] = cls.fingerprint(own), first + nulls, count
        return cls(table, prints, firsts, counts, begins, nulls)

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)

    def records(self, keys: list[int | None]) -> list[range]:
        """The records of each key; none for keys that are not here."""
        wanted = np.array([0 if k is None else k for k in keys], np.int64)
        at = self.table.number(wanted)
        known = (at >= 0) & (self.prints[np.maximum(at, 0)] == self.fingerprint(wanted)) if self.table.size else np.zeros(len(wanted), bool)
        return [range(self.nulls) if k is None else range(int(self.first[a]), int(self.first[a] + self.count[a])) if ok else range(0) for k, a, ok in zip(keys, at, known, strict=True)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        levels = {f"level{n}": np.packbits(bits) for n, bits in enumerate(self.table.levels)}
        np.savez(out, widths=np.array([len(x) for x in self.table.levels], np.int64), prints=self.prints, first=self.first, count=self.count, begins=self.begins, nulls=np.array([self.nulls]), **levels)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        z = np.load(io.BytesIO(data))
        levels = [np.unpackbits(z[f"level{n}"], count=int(w)).astype(bool) for n, w in enumerate(z["widths"])]
        return cls(PerfectHash(levels), z["prints"], z["first"], z["count"], z["begins"], int(z["nulls"][0]))


class Writer:
    """One shard's files, streamed."""

    def __init__(self, path: str, shard: int, width: int):
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(path)
        self.stem, self.mark, self.width = f"{root}/{shard:06d}", uuid.uuid4().hex, width
        self.files.create_dir(root, recursive=True)
        self.out = self.files.open_output_stream(f"{self.stem}.ids.{self.mark}")
        self.keys, self.begins = [], [0]

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.begins.append(self.begins[-1] + len(ids) // self.width)

    def close(self) -> tuple[int, int, int | None, int | None]:
        """Documents, ids, the first and the last key."""
        self.out.close()
        index = Index.build(self.keys, np.array(self.begins, np.int64))
        with self.files.open_output_stream(f"{self.stem}.idx.{self.mark}") as f:
            f.write(index.dump())
        for kind in ("ids", "idx"):
            from pyarrow import fs

            final = f"{self.stem}.{kind}"
            if self.files.get_file_info(final).type != fs.FileType.NotFound:
                self.files.delete_file(final)
            self.files.move(f"{final}.{self.mark}", final)
        return len(self.keys), self.begins[-1], self.keys[0], self.keys[-1]


#: The manifest has a row for each shard, and readers hold it: a corpus of more documents than this many shards take has larger shards.
MOST_SHARDS = 65_536
MANIFEST = "shard int, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint, start bigint"
#: A task of a lookup hands on its records when they hold so many bytes.
OUT_BYTES = 16 << 20


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, width: int = 2, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Writes the files of all documents below ``path`` (a URI that driver and executors share).

    Returns the manifest: rows MANIFEST, one for each shard; ``start`` is the number of ids of all shards before.
    """
    spark = docs.sparkSession
    name = tokenizer or default_tokenizer()
    shards = min(MOST_SHARDS, max(1, -(-docs.count() // docs_per_shard)))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(name, width)
        end = np.array([end_id], encoder.kind).tobytes()
        now, writer, out = None, None, []
        for b in batches:
            for shard, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if shard != now:
                    if writer:
                        out.append((now, *writer.close()))
                    now, writer = shard, Writer(path, shard, width)
                writer.add(k, encoder.encode(t.as_py()) + end)
        if writer:
            out.append((now, *writer.close()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["shard", "n_docs", "n_ids", "first_key", "last_key"])

    # repeated keys are dealt by their texts, and repeated rows by their places, so no key is bound to one shard
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    order = [F.col("key").asc_nulls_first(), F.col("h"), F.col("n")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "key", "text")
    with batch_rows(spark):
        manifest = cut(dealt.mapInArrow(stored, "shard int, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint"))
    total, known = 0, []
    for r in sorted(manifest.collect()):  # one row for each shard
        known.append((*r, total))
        total += r.n_ids
    return spark.createDataFrame(known, MANIFEST)


def lookup(keys: DataFrame, path: str, manifest: DataFrame, key: str = "doc_id", width: int = 2) -> DataFrame:
    """Records of the given keys, each key taken once, from the files: key, start, n_tokens, ids_crc32 (of the ids as 32-bit numbers), ids (as stored)."""
    shards = sorted(manifest.collect())  # one row for each shard
    starts = {r.shard: r.start for r in shards}
    with_nulls = [r.shard for r in shards if r.first_key is None]
    keyed = [r for r in shards if r.last_key is not None]
    lasts = np.array([r.last_key for r in keyed], np.int64)
    firsts = np.array([r.last_key if r.first_key is None and r.n_docs == 1 else -(1 << 63) if r.first_key is None else r.first_key for r in keyed], np.int64)
    numbers = [r.shard for r in keyed]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, out = b.column(0).to_pylist(), []
            asked = np.array([0 if k is None else k for k in own], np.int64)
            low, high = np.searchsorted(lasts, asked, side="left"), np.searchsorted(firsts, asked, side="right")
            for k, i, j in zip(own, low.tolist(), high.tolist(), strict=True):
                out += [(s, k) for s in (with_nulls if k is None else numbers[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([k for _, k in out], pa.int64())], ["shard", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        now, index, data, out, held = None, None, None, [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "start", "n_tokens", "ids_crc32", "ids"])

        for b in batches:
            shard_of, own = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(own):
                end = at
                while end < len(own) and shard_of[end] == shard_of[at]:
                    end += 1
                if shard_of[at] != now:
                    now = shard_of[at]
                    if data is not None:
                        data.close()
                    with files.open_input_stream(f"{root}/{now:06d}.idx") as f:
                        index = Index.load(f.read())
                    data = files.open_input_file(f"{root}/{now:06d}.ids")
                for k, records in zip(own[at:end], index.records(own[at:end]), strict=True):
                    for r in records:
                        a, z = int(index.begins[r]), int(index.begins[r + 1])
                        raw = data.read_at((z - a) * width, a * width)
                        wide = np.frombuffer(raw, np.dtype(f"<u{width}")).astype("<u4").tobytes()
                        out.append((k, starts[now] + a, z - a, zlib.crc32(wide), raw))
                        held += len(raw) + 100
                        if held > OUT_BYTES:
                            yield batch()
                            out, held = [], 0
                at = end
        yield batch()

    rows = keys.select(F.col(key).cast("bigint").alias("key")).distinct().mapInArrow(placed, "shard int, key bigint")
    dealt = rows.repartitionById(max(1, len(starts)), F.col("shard")).sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary").withColumnRenamed("key", key)


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes all documents and looks every key up again."""
    path = path or f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return lookup(docs, path, write(docs, path, key, text), key)
