"""Chains of starts in long streams: batches and windows that each begin where the one before ends, found by many tasks.

In some rules what begins at a row ends at a place that this row alone decides, and the next begins there. Each row then has a pointer to the
next start, were it a start itself. The rows of a stream that really are starts are the chain from its first row. A fold would
follow it row by row; here a stream that holds any share of all rows is dealt over parts of consecutive rows.

- ``next_starts`` finds the pointers by merging rows and questions in order of their values.
- Each part follows its own pointers, from its last row to its first: where the chain leaves the part, after how many starts.
- Only rows that a chain enters a part by matter between parts. They point to one another; the chain from the first row is found by doubling, each
  round joining the pointers with themselves, so the rounds are the logarithm of the number of parts.
- Each part then marks its starts from the row it is entered by.

Every step is a shuffle by ranges or a join on places, and is written for the next. A part's places and pointers are what a task holds.

Where the next start is the first row whose value is a fixed step above the start's, ``stepped`` needs no pointers and far less written.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators.lineage import cut

#: About as many rows as a part holds.
PART_ROWS = 500_000


def _parts(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))


def _ranged(rows: DataFrame, parts: int, *by: str) -> DataFrame:
    """The rows, written, with ``part``: consecutive ranges in order of ``by``, which no two rows have alike."""
    return cut(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))


def placed(rows: DataFrame, key: Column, order: list[Column], size: Column) -> DataFrame:
    """Each row as ``row`` with ``k`` (its stream), ``place`` (from 1), ``size`` and ``total`` (sizes up to and with it)."""
    by = [f"o{i}" for i in range(len(order))]
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    marked = rows.select(row, F.struct(key.alias("k")).alias("k"), *[c.alias(o) for c, o in zip(order, by, strict=True)], size.cast("long").alias("size")).withColumn("id", F.monotonically_increasing_id())
    marked = cut(marked)
    parts = _ranged(marked, _parts(marked), "k", *by, "id")
    sums = parts.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of a stream
    starts = sums.select("k", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "s")])
    inside = Window.partitionBy("k", "part").orderBy(*by, "id")
    local = parts.withColumn("place", F.row_number().over(inside)).withColumn("total", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(starts, ["k", "part"]).select("row", "k", (F.col("place") + F.col("n0")).alias("place"), "size", (F.col("total") + F.col("s0")).alias("total"))
    return cut(out)


def next_starts(rows: DataFrame, value: Column, wanted: Column, strict: bool, step: int) -> DataFrame:
    """Per row (k, place) of streams in which ``value`` never falls: ``next``, the place ``step`` behind the first row whose value reaches ``wanted`` (is above it, if ``strict``); null if none does."""
    own = F.lit(0 if strict else 1)  # rows of the very value stand before the question, or behind it
    values = rows.select("k", "place", value.alias("v"), own.alias("kind"), F.lit(False).alias("asks"))
    questions = rows.select("k", "place", wanted.alias("v"), (1 - own).alias("kind"), F.lit(True).alias("asks"))
    both = values.unionByName(questions)
    ranged = _ranged(both, _parts(both), "k", "v", "kind", "place")
    place = F.when(~F.col("asks"), F.col("place"))
    # places rise with values, so the least place behind is the first; from the end on, as Spark looks at all rows behind each anew where a frame ends with the last
    behind = Window.partitionBy("k", "part").orderBy(F.desc("v"), F.desc("kind"), F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("k").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of a stream
    carried = ranged.groupBy("k", "part").agg(F.min(place).alias("p")).select("k", "part", F.min("p").over(later).alias("carried"))
    found = ranged.withColumn("found", F.min(place).over(behind)).where("asks").join(carried, ["k", "part"])
    return found.select("k", "place", (F.coalesce("found", "carried") + step).alias("next"))


def _runs(place: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """The rows of each stream in each part: places of one stream follow one another, those of the next begin at 1."""
    cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (part[1:] != part[:-1]), True]) if len(place) else np.array([0])
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = list(batches)
    return pa.Table.from_batches(held) if held else None


def _leaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the rows (k, place, next) of a part its number, where the chain from each leaves it (leaves), the starts there and the last of them."""
    from pyspark import TaskContext

    t = _whole(batches)
    if t is None:
        return
    own = np.full(t.num_rows, TaskContext.get().partitionId(), np.int32)
    place, following = t["place"].to_numpy(), np.nan_to_num(t["next"].to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
    leaves, starts, last = following.copy(), np.ones(len(place), np.int64), place.copy()
    for lo, hi in _runs(place, own):
        first = int(place[lo])
        for i in range(hi - 1, lo - 1, -1):
            at = int(following[i]) - first + lo
            if i < at < hi:
                leaves[i], starts[i], last[i] = leaves[at], starts[at] + 1, last[at]
    columns = [pa.array(own), pa.array(leaves, mask=leaves < 0), pa.array(starts), pa.array(last)]
    for name, column in zip(("part", "leaves", "starts", "last"), columns, strict=True):
        t = t.append_column(name, column)
    yield from t.combine_chunks().to_batches()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, part, place, next, entered, before, last), whole parts of them, to (k, place, batch, start)."""
    t = _whole(batches)
    if t is None:
        return
    number = lambda c: np.nan_to_num(t[c].to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
    part, place, following, entered, before, last = (number(c) for c in ("part", "place", "next", "entered", "before", "last"))
    batch, start = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for lo, hi in _runs(place, part):
        first, mark = int(place[lo]), np.zeros(hi - lo, np.int64)
        at = int(entered[lo]) - first
        while 0 <= at < hi - lo:
            mark[at] = 1
            at = int(following[lo + at]) - first
        batch[lo:hi] = before[lo] - 1 + np.cumsum(mark)
        start[lo:hi] = np.maximum.accumulate(np.where(mark == 1, place[lo:hi], last[lo]))
    yield from pa.table({"k": t["k"], "place": t["place"], "batch": batch, "start": start}).combine_chunks().to_batches()


def chained(pointers: DataFrame) -> DataFrame:
    """Rows (k, place, next) of whole streams to (k, place, batch, start): the number, from 0, and the place of the start that each row belongs to."""
    key = pointers.schema["k"].dataType.simpleString()
    pointers = cut(pointers)
    dealt = pointers.select("k", "place", "next").repartitionByRange(_parts(pointers), "k", "place").sortWithinPartitions("k", "place")
    leaps = cut(dealt.mapInArrow(_leaps, f"k {key}, place bigint, next bigint, part int, leaves bigint, starts bigint, last bigint"))
    doors = leaps.where("leaves IS NOT NULL").select("k", F.col("leaves").alias("place")).unionByName(leaps.where("place = 1").select("k", "place")).distinct()
    entries = cut(leaps.join(doors, ["k", "place"], "left_semi").select("k", "part", "place", "leaves", "starts", "last"))
    pairs, met = cut(entries.where("leaves IS NOT NULL").select("k", "place", F.col("leaves").alias("to"))), cut(entries.where("place = 1").select("k", "place"))
    known = met.count()
    while True:
        met = cut(met.unionByName(met.join(pairs, ["k", "place"]).select("k", F.col("to").alias("place"))).distinct())
        now = met.count()
        if now == known:
            break
        known = now
        further = pairs.select("k", F.col("place").alias("to"), F.col("to").alias("end"))
        pairs = cut(pairs.join(further, ["k", "to"]).select("k", "place", F.col("end").alias("to")))
    # a chain enters a part at one row at most; parts that it passes over belong to the start before
    entered = entries.join(met, ["k", "place"], "left_semi").select("k", "part", F.col("place").alias("entered"), "starts", F.col("last").alias("l"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = leaps.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).join(entered, ["k", "part"], "left")
    told = told.select("k", "part", "entered", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("before"), F.last("l", ignorenulls=True).over(earlier).alias("last"))
    rows = leaps.select("k", "part", "place", "next").join(told, ["k", "part"])
    dealt = rows.repartition(_parts(leaps), "part").sortWithinPartitions("part", "k", "place")
    return cut(dealt.select("k", "part", "place", "next", "entered", "before", "last").mapInArrow(_marks, f"k {key}, place bigint, batch bigint, start bigint"))


def with_batches(rows: DataFrame, marks: DataFrame, own: list[str], **made: Column) -> DataFrame:
    """The caller's rows of ``placed`` with columns made of ``place``, ``batch`` and ``start``."""
    joined = rows.select("row", "k", "place").join(marks, ["k", "place"])
    return joined.select(*[F.col("row").getField(c).alias(c) for c in own], *[c.alias(n) for n, c in made.items()])


# -- chains of values: the next start is the first row whose value is a step above the start's ----------------------------
#
# No row has to know its next start, then: a part tells only where chains leave it, as the value that is wanted next, and the parts behind, which are ranges of
# values, say which row that is. What goes to the driver is one row for each part.


class _Part(NamedTuple):
    """A part of consecutive rows: if its first key is the last one of the part before (joined), if it holds one key (single), its last value, and the sizes of its last key."""

    part: int
    joined: bool
    single: bool
    last: int
    total: int


class _Streams:
    """The parts in order. A key that goes on in the next part is the last of the one and the first of the other."""

    def __init__(self, parts: list[_Part]):
        n = len(parts)
        self.parts, self.at = parts, {p.part: i for i, p in enumerate(parts)}
        self.begin, self.offset, self.end = list(range(n)), [0] * n, list(range(n))
        for i in range(1, n):
            if parts[i].joined:
                self.begin[i], self.offset[i] = self.source(i - 1), self.shift(i - 1) + parts[i - 1].total
        for i in range(n - 2, -1, -1):
            if parts[i + 1].joined:
                self.end[i] = self.end[i + 1] if parts[i + 1].single else i + 1
        # a key that ends inside a part ends there for all values
        self.reach = np.array([p.last if p.single else np.iinfo(np.int64).max for p in parts], np.int64)

    def source(self, i: int) -> int:
        """The part in which the last key of a part begins."""
        return self.begin[i] if self.parts[i].single else i

    def shift(self, i: int) -> int:
        """The sizes of the last key of a part in the parts before."""
        return self.offset[i] if self.parts[i].single else 0

    def route(self, i: int, wanted: np.ndarray) -> np.ndarray:
        """The first part behind in which the last key of a part reaches each value; -1 if it doesn't."""
        lo, hi = i + 1, self.end[i] + 1
        found = np.searchsorted(self.reach[lo:hi], wanted, "left") + lo
        return np.where(found < hi, found, -1)


def _begins(k: pa.ChunkedArray) -> np.ndarray:
    """Where keys begin in rows in order of keys; null and NaN are keys like any other."""
    if pa.types.is_nested(k.type):
        held = k.to_pylist()
        return np.array([i == 0 or held[i] != held[i - 1] for i in range(len(held))], bool)
    codes = k.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.r_[True, codes[1:] != codes[:-1]]


def _leavings(step: int) -> Callable:
    """Adds to the rows (k, v, size) of a part, in order: its number, whether the row is a key's first here (first), whether its key is the part's last one (ends);
    and for rows of that key that a chain may enter by, where it leaves the part (leaves: the value wanted next), the starts until then and the key's sizes before the last of them (since)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = _whole(batches)
        if t is None or not t.num_rows:
            return
        first, size, n = _begins(t["k"]), t["size"].to_numpy(), t.num_rows
        lo = int(np.flatnonzero(first)[-1])
        v, before = t["v"].to_numpy()[lo:], np.cumsum(size[lo:]) - size[lo:]
        to = np.searchsorted(v, v + step, "left")
        doors = int(to[0]) + 1  # what chains want of a part is less than a step above a value before it
        jump, steps = np.where(to < len(v), to, np.arange(len(v))), (to < len(v)).astype(np.int64)
        while not np.array_equal(further := jump[jump], jump):
            steps, jump = steps + steps[jump], further
        ends, row = np.arange(n) >= lo, np.arange(n) - lo
        door = lambda x: pa.array(np.r_[np.zeros(lo, np.int64), x], mask=(row < 0) | (row >= doors))
        made = {"part": pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), "first": pa.array(first), "ends": pa.array(ends), "leaves": door(v[jump] + step), "starts": door(steps + 1), "since": door(before[jump])}
        for name, column in made.items():
            t = t.append_column(name, column)
        yield from t.combine_chunks().to_batches()

    return run


def _asks(streams: _Streams) -> Callable:
    """Rows (part, leaves) to what is asked of a part behind that holds nothing else: (part, v, stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, leaves = b.column("part").to_numpy(), b.column("leaves").to_numpy()
            for p in np.unique(part).tolist():
                i = streams.at[p]
                wanted = np.unique(leaves[part == p])
                at = streams.route(i, wanted)
                held = np.array([j >= 0 and streams.parts[j].single for j in at.tolist()], bool)
                to = np.array([streams.parts[j].part for j in at[held].tolist()], np.int32)
                yield pa.record_batch({"part": pa.array(to), "v": pa.array(wanted[held]), "stream": pa.array(np.full(len(to), streams.parts[streams.source(i)].part, np.int32))})

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and questions (with a stream) of whole parts to (stream, wanted, part, leaves, starts, since), which are those of the first row that reaches what is wanted."""
    t = _whole(batches)
    if t is None:
        return
    part, v, asks = t["part"].to_numpy(), t["v"].to_numpy(), t["stream"].is_valid().to_numpy()
    for p in np.unique(part[asks]).tolist():
        rows, asked = np.flatnonzero((part == p) & ~asks), np.flatnonzero((part == p) & asks)
        rows = rows[np.argsort(v[rows], kind="stable")]
        at = t.take(pa.array(rows[np.searchsorted(v[rows], v[asked], "left")]))
        q = t.take(pa.array(asked))
        yield from pa.table({"stream": q["stream"], "wanted": q["v"], **{c: at[c] for c in ("part", "leaves", "starts", "since")}}).combine_chunks().to_batches()


def _entered(leavings: DataFrame, streams: _Streams) -> dict[int, tuple[int, int, int]]:
    """Per part that begins inside a key's rows: the value that its next start is to reach, the sizes before the start in force, and that start's number."""
    parts = streams.parts
    ahead = [i for i in range(len(parts) - 1) if parts[i + 1].joined]  # the parts whose last keys go on
    if not ahead:
        return {}
    inner = [i for i, p in enumerate(parts) if p.joined and p.single]
    number = lambda held: F.col("part").isin([parts[i].part for i in held])
    doors = cut(leavings.where("leaves IS NOT NULL").select("part", "first", "v", "leaves", "starts", "since"))
    going = doors.where(number(ahead) & (F.col("first") | number(inner)))  # where a key begins, it is entered by its first row
    asks = going.select("part", "leaves").mapInArrow(_asks(streams), "part int, v bigint, stream int").distinct()
    rows = doors.where(number(inner)).select("part", "v", "leaves", "starts", "since")
    both = rows.unionByName(asks, allowMissingColumns=True).select("part", "v", "stream", "leaves", "starts", "since")
    kinds = "part int, leaves bigint, starts bigint, since bigint"
    pairs = cut(both.repartition(4 * len(parts), "part").mapInArrow(_answers, f"stream int, wanted bigint, {kinds}"))  # by so many, as few parts often meet in a task
    heads = cut(going.where(number({streams.source(i) for i in ahead}) & F.col("first")).select(F.col("part").alias("stream"), "part", "leaves", "starts", "since"))
    met, jumps = heads.select("stream", F.col("leaves").alias("wanted")), pairs.select("stream", "wanted", F.col("leaves").alias("to"))
    longest = max(streams.end[i] - streams.source(i) for i in ahead) + 1
    for doubling in range(longest.bit_length()):
        if doubling:
            jumps = cut(jumps.join(jumps.select("stream", F.col("wanted").alias("to"), F.col("to").alias("end")), ["stream", "to"]).select("stream", "wanted", F.col("end").alias("to")))
        met = cut(met.unionByName(met.join(jumps, ["stream", "wanted"]).select("stream", F.col("to").alias("wanted"))).distinct())
    chains: dict[int, list] = {}
    for r in heads.unionByName(pairs.join(met, ["stream", "wanted"]).drop("wanted")).collect():  # one row for each part at most
        chains.setdefault(r.stream, []).append((r.leaves, r.starts, r.since + streams.shift(streams.at[r.part])))
    entered = {}
    ends = {s: (list(itertools.accumulate(x[1] for x in c)), c) for s, c in ((s, sorted(c)) for s, c in chains.items())}
    for i in (i + 1 for i in ahead):
        counts, chain = ends[parts[streams.begin[i]].part]
        at = bisect_right(chain, parts[i - 1].last, key=lambda x: x[0])  # no row before the part reaches it, so the last start there wants it
        entered[parts[i].part] = (chain[at][0], chain[at][2], counts[at] - 1)
    return entered


def _numbers(entered: dict, offsets: dict, step: int) -> Callable:
    """Rows (k, v, size, first, part) of whole parts, in order, to (k, v, size, number, since). A task holds a batch and the start in force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, wanted, held, number, total = None, 0, 0, -1, 0
        for b in batches:
            v, size, first, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("v", "size", "first", "part"))
            numbers, since = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
            begins = np.flatnonzero(first)
            cuts = np.unique(np.r_[0, begins, len(v)]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if first[lo]:
                    went_on = part[lo] != here
                    here = int(part[lo])
                    total = offsets.get(here, 0) if went_on else 0
                    wanted, held, number = entered[here] if went_on and here in entered else (int(v[lo]), 0, -1)
                own, sums = v[lo:hi], total + np.cumsum(size[lo:hi]) - size[lo:hi]
                total = int(sums[-1] + size[hi - 1])
                starts, at = [], int(np.searchsorted(own, wanted, "left"))
                while at < hi - lo:
                    starts.append(at)
                    wanted = int(own[at]) + step
                    at += int(np.searchsorted(own[at:], wanted, "left"))
                mark = np.zeros(hi - lo, np.int64)
                mark[starts] = 1
                nth = np.cumsum(mark)
                numbers[lo:hi], since[lo:hi] = number + nth, sums - np.r_[held, sums[starts]][nth]
                if starts:
                    number, held = number + len(starts), int(sums[starts[-1]])
            yield pa.record_batch({"k": b.column("k"), "v": b.column("v"), "size": b.column("size"), "number": pa.array(numbers), "since": pa.array(since)})

    return run


def stepped(rows: DataFrame, step: int) -> DataFrame:
    """Rows (k, v, size), no two alike in k and v, with ``number`` and ``since``: a key's first row is a start, and each next start is the first row at
    least ``step`` above the start before. Each row has the number, from 0, of the start that it belongs to, and the sizes of the rows from that start to before it.
    ``step`` is above 0. Null is a key like any other; no value or size is null. The rows (v and size long) are read three times, so they should be written."""
    key = rows.schema["k"].dataType.simpleString()
    parts = max(1, -(-rows.count() // PART_ROWS))
    own = f"k {key}, v bigint, size bigint"
    dealt = rows.repartitionByRange(parts, "k", "v").sortWithinPartitions("k", "v")
    leavings = cut(dealt.mapInArrow(_leavings(step), f"{own}, part int, first boolean, ends boolean, leaves bigint, starts bigint, since bigint"))
    bounds = leavings.groupBy("part").agg(F.min(F.struct("k", "v")).alias("lo"), F.max(F.struct("k", "v")).alias("hi"), F.sum(F.when(F.col("ends"), F.col("size"))).alias("total"))
    before = F.lag(F.struct("hi.k")).over(Window.orderBy("part"))  # one row for each part
    told = bounds.select("part", before.eqNullSafe(F.struct("lo.k")).alias("joined"), F.col("lo.k").eqNullSafe(F.col("hi.k")).alias("single"), F.col("hi.v").alias("last"), "total")
    streams = _Streams([_Part(*r) for r in sorted(told.collect())])
    entered = _entered(leavings, streams)
    offsets = {p.part: o for p, o in zip(streams.parts, streams.offset, strict=True) if o}
    whole = leavings.select("k", "v", "size", "first", "part").repartition(4 * parts, "part").sortWithinPartitions("part", "k", "v")
    return whole.mapInArrow(_numbers(entered, offsets, step), f"{own}, number bigint, since bigint")
