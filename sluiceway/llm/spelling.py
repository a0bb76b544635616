"""Groups of spelling variants by Aho-Corasick halves.

Words are counted over whole texts; a word of a corpus is near another if one inserted, deleted or replaced code point leads
from one to the other. A word's form is its most frequent near word, if that is ``factor`` times as frequent at least.

One edit leaves one half of a word as it was. So each word gives two segments, its first and its second half, and automata
hold the segments of all words; every word is scanned through the automata that can hold a segment of a near word.
A first half counts where it begins the scanned word, a second half where it ends it, and only for words whose lengths
differ by one at most; then the rest is verified. A near word that shares both halves counts by the first.

Shards: a segment is known by its kind, its word's length and its outermost EDGE code points, which a scanned word shares
with it, so a word meets the automata of two kinds and three lengths and no others. Each of these keys has its shard; the
segments of a key of more than SHARD_CHARS code points are dealt over several, and the words to be scanned are copied to each.
Shards hold about SHARD_CHARS code points of segments, and words stream through: a task holds one automaton. What leaves a shard
is one row for each word with a near word there (how many, and the most frequent), not pairs.

Counting: each task counts its texts' words in a table of bounded size before anything is shuffled, so a frequent word is a row
for each task. Null texts have no words. A null key counts as an empty one in the deletion rule. Rows of one key are texts like any others. Ties for a form go to
the smallest word in code-point order. Other columns are ignored. An empty table, or one without words often enough, gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import batch_rows, cut, spread_join

SHORTEST, RAREST, FACTOR = 6, 5, 5
#: One run in so many loses a code point, by its checksum; 0 for none.
DELETE_ONE_IN = 199
EDGE = 3
SHARD_CHARS = 1_000_000
#: Words that a task counts before it lets the counts go.
HELD_WORDS = 200_000

_LETTERS = {*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)}
#: For texts as Latin-1 bytes, in which all letters are one byte: letters stay, A-Z in lower case, all else is a space.
FOLD = bytes(c + 32 if ord("A") <= c <= ord("Z") else c if c in _LETTERS else 32 for c in range(256))


def words_of(key: str, text: str | None, shortest: int = SHORTEST, delete_one_in: int = DELETE_ONE_IN) -> Counter:
    """The text's words, as Latin-1 bytes, and how often each is there: what is left of runs by the deletion rule and is long enough."""
    runs = Counter((text or "").encode("latin-1", "replace").translate(FOLD).split(b" "))
    out: Counter = Counter()
    start = zlib.crc32(f"{key}:".encode())
    for run, n in runs.items():
        if len(run) < shortest:  # deletions don't make it longer
            continue
        if delete_one_in:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % delete_one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < shortest:
                    continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, rarest: int = RAREST, delete_one_in: int = DELETE_ONE_IN) -> DataFrame:
    """The corpus's words of ``shortest`` code points and ``rarest`` occurrences at least: word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for w, n in words_of(k, t.as_py(), shortest, delete_one_in).items():
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield counts()
                    held.clear()
        yield counts()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= rarest)


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


class Shard:
    """An automaton over segments, each with the words that hold it. Kind 0 is a first half, 1 a second.

    Many words may share a half, so under it they are told apart by the halves of their rest: one edit leaves one of these as it was, too."""

    def __init__(self) -> None:
        self.words: dict[str, dict[tuple[int, int], tuple[dict, dict]]] = {}
        self.automaton = None

    def add(self, kind: int, word: str, n: int) -> None:
        parts = halves(word)
        by = self.words.setdefault(parts[kind], {}).setdefault((kind, len(word)), ({}, {}))
        for at, rest in zip(by, halves(parts[1 - kind]), strict=True):
            at.setdefault(rest, []).append((n, word))

    def near(self, word: str, kind: int, length: int) -> Iterator[tuple[int, str]]:
        """Words of this length with this kind of half in the right place of ``word`` that are one edit away."""
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for segment, by in self.words.items():
                self.automaton.add_word(segment, (len(segment), by))
            self.automaton.make_automaton()
        last, first = len(word) - 1, length // 2
        other = length - first if kind == 0 else first  # how long the rest of such a word is
        for end, (size, by) in self.automaton.iter(word):
            if (end != last) if kind else (end != size - 1):
                continue
            found = by.get((kind, length))
            if found is None:
                continue
            rest = word[: last + 1 - size] if kind else word[size:]
            start, tail = other // 2, other - other // 2
            for n, w in found[0].get(rest[:start], ()):
                if one_edit(word, w) and not (kind and word.startswith(w[:first])):  # those that share both halves count by the first
                    yield n, w
            for n, w in found[1].get(rest[len(rest) - tail :], ()) if len(rest) >= tail else ():
                own = w[:start] if kind else w[first : first + start]
                if not rest.startswith(own) and one_edit(word, w) and not (kind and word.startswith(w[:first])):
                    yield n, w


def near_words(counted: DataFrame) -> DataFrame:
    """Words (word, n) to those with near words: word, n_near, best (n and word of the most frequent near word)."""
    chars = F.char_length("word")
    words = counted.select("word", "n", chars.alias("len"))
    total = words.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    least = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-total // SHARD_CHARS))
    edge = lambda kind: F.when(kind == 0, F.substring("word", 1, EDGE)).otherwise(F.substring("word", -EDGE, EDGE))
    key = lambda kind, size: F.struct(kind.alias("kind"), size.alias("len"), edge(kind).alias("edge"))
    kinds = F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    held = words.select("word", "n", "len", kinds).withColumn("key", key(F.col("kind"), F.col("len")))
    lengths = F.explode(F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1)).alias("of")
    scanned = words.select("word", "n", lengths, kinds).select("word", "n", key(F.col("kind"), F.col("of")).alias("key"))
    # a key that one automaton can't hold; there are 2 * total / SHARD_CHARS of them at most
    sizes = held.groupBy("key").agg(F.sum("len").alias("chars"))
    large = sizes.where(F.col("chars") > SHARD_CHARS).select("key", F.ceil(F.col("chars") / SHARD_CHARS).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    held = held.join(large, "key", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).withColumn("scan", F.lit(False))
    scanned = scanned.join(sizes.select("key"), "key", "left_semi").join(large, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("scan", F.lit(True))
    # the parts of a key lie in shards of their own: a word copied to several parts meets each segment once
    columns = [F.pmod(F.pmod(F.xxhash64("key"), F.lit(shards)) + F.col("part"), F.lit(shards)).cast("int").alias("shard"), "scan", F.col("key.kind").alias("kind"), F.col("key.len").alias("len"), "word", "n"]
    dealt = held.select(columns).unionByName(scanned.select(columns))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "scan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(), None
        for b in batches:
            out = []
            for at, scan, kind, length, word, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != number:
                    shard, number = Shard(), at
                if not scan:
                    shard.add(kind, word, n)
                    continue
                found, best = 0, None
                for near in shard.near(word, kind, length):
                    found += 1
                    if best is None or (-near[0], near[1]) < (-best[0], best[1]):
                        best = near
                if best:
                    out.append((word, found, *best))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "found", "n", "near"])

    found = dealt.mapInArrow(run, "word string, found bigint, n bigint, near string")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), "best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Words with forms (word, form) to (word, root): the last word of each chain. Chains halve in each round, as a word takes over
    how far its own target has come; a target that many words share is joined in parts."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        counts = now.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
        further = cut(further.join(counts, "root"))  # targets that go on themselves
        if not further.limit(1).count():
            return now
        now = cut(spread_join(now, further, "root", "m", now.count(), "word", "left").select("word", F.coalesce("next", "root").alias("root")))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, rarest: int = RAREST, factor: float = FACTOR, delete_one_in: int = DELETE_ONE_IN) -> DataFrame:
    """Per word of the corpus: word, n, n_near (near words), form (null if none), form_n, root (the word that its forms lead to, itself if it has none).

    A text without words often enough adds nothing. Form chains end, as each form is more frequent than its word."""
    if factor <= 1:
        raise ValueError("a form has to be more frequent than its words")
    if shortest < 2 * EDGE:
        raise ValueError(f"each half of a word needs {EDGE} code points")
    with batch_rows(docs.sparkSession):
        counted = cut(word_counts(docs, key, text, shortest, rarest, delete_one_in))
    enough = F.col("best.n") >= factor * F.col("n")
    named = counted.join(near_words(counted), "word", "left")
    named = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, F.col("best.n")).alias("form_n")))
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
