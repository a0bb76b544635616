"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments of about SEGMENT_WORDS words: for each term of a segment the sorted list
of its positions, and the documents that lie in it. A position is left free between documents, so no
phrase crosses two. A document longer than a segment is cut into pieces that overlap by what a phrase
needs. Segments are bounded, so a term that fills a third of the corpus is as many bounded lists as there are segments.

A search takes the segments as they lie, with no shuffle: it starts each phrase from its rarest term in the segment
and intersects the other terms' lists, shifted by their offsets, from the rarest on. Test phrases come to the
tasks in blocks of bounded size, by a broadcast each, against the one index; what blocks and pieces find in
one document is joined by the document's name in the index, which is its row's, not its key.

Null and blank texts have no words: they hit nothing, and items without words have no windows. Repeated
rows are documents of their own; repeated items count once by id; null item ids are not reported, but
their windows hit. Empty tables give empty results, or documents without hits. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluiceway.llm.common import batch_rows, cut

WINDOW = 10
SEGMENT_WORDS = 200_000
BLOCK_WORDS = 500_000
CANDIDATES = 2_000_000
#: Segments, of some 1.5 MB each, that a task holds at a time as it writes, reads and searches them.
HELD = 4

#: Bytes of words stay (A-Z in lower case, digits, all of non-ASCII characters), others become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | str | None) -> list[bytes]:
    """Lower-cases A-Z and takes the runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).translate(FOLD).split()


def split_words(texts: list[bytes | None]) -> list[pa.StringArray]:
    """The words of many texts, each an Arrow array."""
    folded = pa.array([b"" if t is None else t.translate(FOLD).strip() for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
    lists = pc.ascii_split_whitespace(folded)
    values, ends, empty = lists.values.cast(pa.string(), safe=False), lists.offsets.to_numpy(), pa.array([], pa.string())
    blank = pc.equal(folded, "").to_pylist()
    return [empty if none else values.slice(a, b - a) for none, a, b in zip(blank, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


SPAN = "struct<first:bigint,last:bigint>"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_words: int | None = None, overlap: int = WINDOW - 1) -> DataFrame:
    """Rows (origin, docs, postings), one for each segment; the caller writes them.

    ``docs``: number, key, first (the piece's first word in its document), start (its place in the segment), words.
    ``origin`` and number name a document. ``postings``: term, positions. Searches of up to ``overlap`` + 1 words find
    all that a document cut in pieces holds.
    """
    segment_words = segment_words or SEGMENT_WORDS
    key_type = docs.schema[key].dataType.simpleString()
    arrow_key = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, number = uuid.uuid4().hex, 0
        pieces: list[tuple] = []  # (number, key, first, words)
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(p[3]) for p in pieces], np.int32)
            starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int32)
            coded = pa.concat_arrays([p[3] for p in pieces]).dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False)
            place = (np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)).astype(np.int32)
            at = place[np.argsort(ids, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(coded.dictionary)))]).astype(np.int32)
            postings = pa.StructArray.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(ends), pa.array(at))], ["term", "positions"])
            own = pa.StructArray.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], arrow_key), pa.array([p[2] for p in pieces], pa.int64()), pa.array(starts), pa.array(sizes)], ["number", "key", "first", "start", "words"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([origin]), one(own), one(postings)], ["origin", "docs", "postings"])

        for batch in batches:
            found = split_words(batch.column(1).cast(pa.binary()).to_pylist())
            for k, ws in zip(batch.column(0).to_pylist(), found, strict=True):
                first = 0
                while True:
                    part = ws.slice(first, segment_words)
                    pieces.append((number, k, first, part))
                    held += len(part) + 1
                    if held >= segment_words:
                        yield flush()
                        pieces, held = [], 0
                    if first + len(part) >= len(ws):
                        break
                    first += max(1, len(part) - overlap)
                number += 1
        if pieces:
            yield flush()

    schema = f"origin string, docs array<struct<number:bigint,key:{key_type},first:bigint,start:int,words:int>>, postings array<struct<term:string,positions:array<int>>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def documents_of(index: DataFrame) -> DataFrame:
    """Rows (origin, number, key, n_words) of the documents in an index."""
    pieces = index.select("origin", F.explode("docs").alias("d"))
    per = pieces.groupBy("origin", F.col("d.number").alias("number"))
    return per.agg(F.any_value("d.key").alias("key"), F.max(F.col("d.first") + F.col("d.words")).alias("n_words"))


class Postings:
    """The lists of one segment that a vocabulary asks for, as one sorted array of term number and position."""

    def __init__(self, postings: pa.StructArray, docs: pa.StructArray, vocabulary: pa.StringArray, n_terms: int):
        lists = postings.field("positions")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        number = pc.index_in(postings.field("term"), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = docs.field("start").to_numpy().astype(np.int64)
        order = np.argsort(number, kind="stable")
        order = order[number[order] >= 0]
        sizes = (ends[order + 1] - ends[order]).astype(np.int64)
        self.count = np.zeros(n_terms, np.int64)
        self.first = np.zeros(n_terms, np.int64)
        before = np.cumsum(sizes) - sizes
        self.count[number[order]], self.first[number[order]] = sizes, before
        at = np.repeat(ends[order] - before, sizes) + np.arange(sizes.sum())
        self.keys = (np.repeat(number[order], sizes) << 32) + flat[at].astype(np.int64)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list."""
        want = (term << 32) + position
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return (position >= 0) & (self.keys[at] == want)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches of windows (rows of term numbers, -1 behind the end): window numbers and first positions."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        big = np.iinfo(np.int64).max
        size = np.where(windows >= 0, self.count[windows], big)
        alive = np.flatnonzero((size > 0).all(axis=1))
        order = np.argsort(size[alive], axis=1, kind="stable")  # offsets from the rarest term on
        todo = np.take_along_axis(size[alive], order[:, :1], axis=1)[:, 0]
        which, starts, lo, total = [], [], 0, np.concatenate([[0], np.cumsum(todo)])
        while lo < len(alive):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CANDIDATES, side="right")) - 1)
            rows = alive[lo:hi]
            n = todo[lo:hi]
            w = np.repeat(np.arange(lo, hi), n)
            anchor = order[lo:hi, 0]
            base = np.repeat(self.first[windows[rows, anchor]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            start = (self.keys[base] & 0xFFFFFFFF) - np.repeat(anchor, n)
            for step in range(1, windows.shape[1]):
                offset = order[w, step]
                term = windows[alive[w], offset]
                ok = (term < 0) | self.has(np.maximum(term, 0), start + offset)
                w, start = w[ok], start[ok]
            which.append(alive[w])
            starts.append(start)
            lo = hi
        if not which:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(which), np.concatenate(starts)

    def near(self, phrase: np.ndarray, distance: int) -> list[tuple[int, int]]:
        """Spans of at most ``distance`` words that hold all distinct terms of a phrase in any order, the shortest at each place of the rarest term."""
        terms = sorted({int(t) for t in phrase if t >= 0}, key=lambda t: self.count[t])
        if not terms or not all(self.count[t] for t in terms):
            return []
        lists = [self.keys[self.first[t] : self.first[t] + self.count[t]] & 0xFFFFFFFF for t in terms]
        found = set()
        for p in lists[0]:
            doc = int(np.searchsorted(self.starts, p, side="right"))
            low = max(int(self.starts[doc - 1]), int(p) - distance + 1)
            high = int(p) + distance if doc >= len(self.starts) else min(int(p) + distance, int(self.starts[doc]) - 1)
            inside = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists[1:]]
            if not all(map(len, inside)):
                continue
            merged = sorted([(int(p), 0)] + [(int(q), k + 1) for k, x in enumerate(inside) for q in x])
            last: dict[int, int] = {}
            best = None
            for q, k in merged:
                last[k] = q
                if len(last) == len(lists):
                    a = min(last.values())
                    if q - a < distance and (best is None or q - a < best[1] - best[0]):
                        best = (a, q)
            if best:
                found.add(best)
        return sorted(found)


def _windows(items: list[tuple], size: int) -> tuple[np.ndarray, list[list], dict[str, int]]:
    """Distinct windows as rows of term numbers, the item ids of each, and the vocabulary."""
    vocabulary: dict[str, int] = {}
    owners: dict[tuple, dict] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w.decode("utf-8", "replace"), len(vocabulary)) for w in words(text)]
        for i in range(max(0, len(ids) - size) + 1 if ids else 0):
            row = tuple(ids[i : i + size])
            owners.setdefault(row, {})[item] = None
    rows = np.full((len(owners), size), -1, np.int64)
    for k, row in enumerate(owners):
        rows[k, : len(row)] = row
    return rows, [list(x) for x in owners.values()], vocabulary


def _blocks(tests: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The tests in blocks of bounded size; each is fetched when its turn comes."""
    rows = tests.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK_WORDS * 6)))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [tuple(r) for r in part.toLocalIterator()]


def search(index: DataFrame, tests: list[tuple], window: int = WINDOW, distance: int | None = None) -> DataFrame:
    """Rows (origin, number, items, spans) of documents with matches of one block of tests (item, text); a document in pieces may have several.

    Spans are merged word ranges [first, last] inside the document; items are ids as strings. With
    ``distance``, a whole item matches where its distinct words stand within that many words, in any order.
    """
    rows, owners, vocabulary = _windows(tests, window) if distance is None else _whole_items(tests)
    shared = index.sparkSession.sparkContext.broadcast((rows, owners, list(vocabulary)))  # a block's windows: bounded by BLOCK_WORDS

    def matches(origin: str, postings: pa.StructArray, docs: pa.StructArray) -> list[tuple]:
        windows, owned, known = shared.value
        lists = Postings(postings, docs, pa.array(known, pa.string()), max(1, len(known)))
        if distance is None:
            which, first = lists.phrases(windows)
            last = first + (windows >= 0).sum(axis=1)[which] - 1
        else:
            hits = [(k, a, b) for k in range(len(windows)) for a, b in lists.near(windows[k], distance)]
            which, first, last = np.array(hits, np.int64).reshape(-1, 3).T
        piece = np.searchsorted(lists.starts, first, side="right") - 1
        numbers, offsets = docs.field("number").to_numpy(), docs.field("first").to_numpy()
        out: dict[int, tuple[set, list]] = {}
        for k in np.lexsort((first, piece)):
            at = int(piece[k])
            items, spans = out.setdefault(at, (set(), []))
            items.update(str(x) for x in owned[which[k]] if x is not None)
            move = int(offsets[at]) - int(lists.starts[at])
            a, b = int(first[k]) + move, int(last[k]) + move
            if spans and a <= spans[-1]["last"] + 1:
                spans[-1]["last"] = max(spans[-1]["last"], b)
            else:
                spans.append({"first": a, "last": b})
        return [(origin, int(numbers[at]), sorted(items), spans) for at, (items, spans) in out.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
        for b in batches:
            for k in range(b.num_rows):
                found = matches(b.column(0)[k].as_py(), b.column(2)[k].values, b.column(1)[k].values)
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["origin", "number", "items", "spans"])

    return index.select("origin", "docs", "postings").mapInArrow(run, f"origin string, number bigint, items array<string>, spans array<{SPAN}>")


def _whole_items(tests: list[tuple]) -> tuple[np.ndarray, list[list], dict[str, int]]:
    longest = max((len(words(t)) for _, t in tests), default=1)
    return _windows(tests, max(1, longest))


def contamination(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", test_text: str = "text", window: int = WINDOW, distance: int | None = None) -> DataFrame:
    """Per document: key, n_words, n_hit, items (ids as strings, sorted), spans, contaminated."""
    spark = docs.sparkSession
    with batch_rows(spark):
        index = cut(build_index(docs, key, text, overlap=(distance or window) - 1), HELD)
    found = None
    for block in _blocks(tests, item, test_text):
        with batch_rows(spark, HELD):  # a row is a segment
            more = cut(search(index, block, window, distance))
        found = more if found is None else found.unionByName(more)
    per = found.groupBy("origin", "number").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    rows = documents_of(index).join(per, ["origin", "number"], "left")
    rows = rows.withColumn("items", F.sort_array(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))).withColumn("spans", F.sort_array(F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["last"] - F.greatest(s["first"] - 1, acc["end"]))).alias("n"), F.greatest(s["last"], acc["end"]).alias("end"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end")), step, lambda a: a["n"])
    return rows.select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), "items", "spans", (n_hit > 0).alias("contaminated"))
