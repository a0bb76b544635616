"""Token counts that follow edits.

Each document has a tree over its pre-tokens, a row of a table: leaves are runs of about LEAF pre-tokens, each with its text and the lengths
and token counts of its pre-tokens; inner nodes, which are made of the leaves when a row is read, hold the
sums of code points and of tokens below them. An edit (at, drop, insert; places in the text before all
edits) descends by sums to the pre-tokens that it touches, re-encodes these with the context that can
change their borders, until a border of the old text is met again, and updates the sums on the way up. Only leaves that an
edit touches are made anew; one that grows beyond MOST pre-tokens is cut.

Null texts are empty. Edits of null, or that are null, do nothing; edits must not overlap, places beyond
the end count as the end. Repeated rows are counted each by itself. An empty table gives an empty
result. Other columns are ignored. Documents are counted one at a time, in the tasks that read them. A tokenizer whose
pre-tokens can't be known one by one (see ``bpe``) has its whole texts encoded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.bpe import Encoder, default_tokenizer, encoder_for
from sluiceway.llm.common import slices

LEAF, MOST = 32, 128
WINDOW = 64
LEAVES = "array<struct<text:string,lengths:array<int>,counts:array<int>>>"
EDITS = "array<struct<at:int,drop:int,insert:string>>"


def leaves_of(text: str, lengths: list[int], counts: list[int]) -> list[tuple[str, list[int], list[int]]]:
    """Pre-tokens as leaves (text, lengths, counts)."""
    out, at = [], 0
    for i in range(0, len(lengths), LEAF):
        own = lengths[i : i + LEAF]
        size = sum(own)
        out.append((text[at : at + size], own, counts[i : i + LEAF]))
        at += size
    return out


class TokenTree:
    """Sums of code points and tokens over runs of pre-tokens, in a heap of nodes."""

    def __init__(self, leaves: list[tuple[str, list[int], list[int]]], encoder: Encoder):
        self.encoder, self.reencoded = encoder, 0
        self._grow(leaves)
        self.pretokens = sum(len(x[1]) for x in self.leaves)

    @classmethod
    def of_text(cls, text: str, encoder: Encoder) -> TokenTree:
        return cls(leaves_of(text, *encoder.pieces(text)), encoder)

    def _grow(self, leaves: list[tuple[str, list[int], list[int]]]) -> None:
        self.leaves = leaves or [("", [], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (text, _, counts) in enumerate(self.leaves):
            self.chars[self.base + k], self.tokens[self.base + k] = len(text), sum(counts)
        for k in range(self.base - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        """Code points."""
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(x[0] for x in self.leaves)

    def _leaf(self, place: int) -> tuple[int, int]:
        """(leaf, its first place) of the leaf that holds a place; the last one that holds something for the end."""
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if start + self.chars[k] <= place and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.base, start

    def _find(self, place: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, its first place) of the pre-token that holds a place; the last one for the end."""
        leaf, start = self._leaf(place)
        at, lengths = 0, self.leaves[leaf][1]
        while at < len(lengths) - 1 and start + lengths[at] <= place:
            start += lengths[at]
            at += 1
        return leaf, at, start

    def _between(self, start: int, end: int) -> str:
        """The text of some places."""
        parts, (leaf, first) = [], self._leaf(start)
        while start < end:
            text = self.leaves[leaf][0]
            parts.append(text[start - first : end - first])
            first += len(text)
            start, leaf = max(start, first), leaf + 1
        return "".join(parts)

    def _borders(self, leaf: int, at: int, start: int) -> Iterator[tuple[int, int, int]]:
        """Pre-tokens from one on: (leaf, pre-token, first place), and at last the end of the text."""
        while leaf < len(self.leaves):
            for k in range(at, len(self.leaves[leaf][1])):
                yield leaf, k, start
                start += self.leaves[leaf][1][k]
            leaf, at = leaf + 1, 0
        yield leaf, 0, start

    def edit(self, at: int, drop: int, insert: str) -> None:
        """Replaces ``drop`` code points at ``at`` by ``insert``."""
        size, context = self.size, self.encoder.context
        at = min(max(at, 0), size)
        drop = min(max(drop, 0), size - at)
        if not drop and not insert:
            return
        if not self.encoder.plain:
            text = self.text
            text = text[:at] + insert + text[at + drop :]
            self._grow(leaves_of(text, *self.encoder.pieces(text)))
            self.pretokens = sum(len(x[1]) for x in self.leaves)
            self.reencoded += self.pretokens
            return
        first_leaf, first, start = self._find(max(0, at - context))
        end, shift = at + drop, len(insert) - drop
        window = WINDOW
        head = self._between(start, at) + insert
        over = (len(self.leaves), 0, size)
        while True:
            stop = min(size, end + window)
            region = head + self._between(end, stop)
            lengths, counts = self.encoder.pieces(region)
            # what stands near the cut of the region may be cut itself, so it isn't trusted
            borders, place = {start}, start
            for n in lengths:
                place += n
                if stop == size or place <= stop + shift - context:
                    borders.add(place)
            met = None
            for leaf, k, where in self._borders(*self._find(end)) if end < size else [over]:
                if where > stop:
                    break
                if where >= end and where + shift in borders:
                    met = (leaf, k, where)
                    break
            if met is not None:
                break
            window *= 4
        leaf, k, where = met
        take, long = 0, 0
        while start + long < where + shift:
            long += lengths[take]
            take += 1
        self.reencoded += take
        self._splice(first_leaf, first, leaf, k, region[:long], lengths[:take], counts[:take])

    def _splice(self, first_leaf: int, first: int, leaf: int, k: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Pre-tokens from (first_leaf, first) to before (leaf, k) become the given ones, all in the first leaf."""
        last = min(leaf, len(self.leaves) - 1)
        gone = sum(len(self.leaves[x][1]) for x in range(first_leaf, last + 1)) - first
        front, tail = self.leaves[first_leaf], ("", [], [])
        if leaf < len(self.leaves):
            behind = self.leaves[leaf]
            tail = (behind[0][sum(behind[1][:k]) :], behind[1][k:], behind[2][k:])
            gone -= len(tail[1])
        self.pretokens += len(lengths) - gone
        for x in range(first_leaf + 1, last + 1):
            self.leaves[x] = ("", [], [])
        if first_leaf < leaf < len(self.leaves):
            self.leaves[leaf], tail = tail, ("", [], [])
        self.leaves[first_leaf] = (front[0][: sum(front[1][:first])] + text + tail[0], front[1][:first] + lengths + tail[1], front[2][:first] + counts + tail[2])
        if len(self.leaves[first_leaf][1]) > MOST:  # as many pre-tokens were made as a new heap costs
            own = self.leaves[first_leaf]
            self._grow([x for x in self.leaves[:first_leaf] + leaves_of(*own) + self.leaves[first_leaf + 1 :] if x[1]])
            return
        for x in range(first_leaf, last + 1):
            self.chars[self.base + x], self.tokens[self.base + x] = len(self.leaves[x][0]), sum(self.leaves[x][2])
        lo, hi = (self.base + first_leaf) // 2, (self.base + last) // 2
        while lo:
            for n in range(lo, hi + 1):
                self._sum(n)
            lo, hi = lo // 2, hi // 2


def _arrow_leaves(rows: list[list[tuple]]) -> pa.Array:
    flat = [x for row in rows for x in row]
    kind = pa.list_(pa.int32())
    leaf = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat], kind)], ["text", "lengths", "counts"])
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf)


def build_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per document: key, ``leaves`` (of its tree) and n_tokens. The caller may write them, and count edits of them later. Other columns pass."""
    path = tokenizer or default_tokenizer()
    others = [c for c in docs.columns if c not in (key, text, "leaves", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in slices(batches):
            rows = [leaves_of(t, *encoder.pieces(t)) for t in ((x or "") for x in batch.column(1).to_pylist())]
            totals = pa.array([sum(sum(x[2]) for x in row) for row in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrow_leaves(rows), totals, *batch.columns[2:]], ["key", "leaves", "n_tokens", *others])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(f"`{c}`") for c in others])
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, leaves {LEAVES}, n_tokens bigint{more}").withColumnRenamed("key", key)


#: What edits lead to.
COUNTS = ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_reencoded"]


def _edited(tree: TokenTree, edits: list[dict] | None) -> tuple[int, ...]:
    """Applies edits, and gives the COUNTS."""
    before = tree.total
    known = [e for e in edits or [] if e and e["at"] is not None]
    for e in sorted(known, key=lambda e: (e["at"], e["drop"] or 0), reverse=True):  # from the end, so places stay
        tree.edit(e["at"], e["drop"] or 0, e["insert"] or "")
    return before, tree.total, tree.size, tree.pretokens, tree.reencoded


def _edits_of(rows: DataFrame, own: str, edits: str, grown: Callable[[pa.Array, Encoder], Iterator[TokenTree]], key: str, tokenizer: str | None, keep: bool) -> DataFrame:
    """Trees grown of a column, and edited: key, leaves (if they are kept) and COUNTS."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in slices(batches):
            out, leaves = [], []
            for tree, changes in zip(grown(batch.column(1), encoder), batch.column(2).to_pylist(), strict=True):
                out.append(_edited(tree, changes))
                leaves.append([x for x in tree.leaves if x[1]] if keep else [])
            columns = list(zip(*out, strict=True)) if out else [[]] * len(COUNTS)
            kept = [_arrow_leaves(leaves)] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, *[pa.array(list(c), pa.int64()) for c in columns]], ["key", *(["leaves"] if keep else []), *COUNTS])

    schema = f"key {rows.schema[key].dataType.simpleString()}, {f'leaves {LEAVES}, ' if keep else ''}" + ", ".join(f"{n} bigint" for n in COUNTS)
    return rows.select(F.col(key).alias("key"), F.col(own).alias("own"), F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, schema).withColumnRenamed("key", key)


def apply_edits(trees: DataFrame, key: str = "doc_id", edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """Trees (``leaves``) with a column of edits to the trees after them: key, leaves, n_tokens (before), n_tokens_edited, n_chars_edited, n_pretokens, n_reencoded.

    ``edits`` is array<struct<at:int, drop:int, insert:string>> in code points of the text before all edits.
    """

    def grown(column: pa.Array, encoder: Encoder) -> Iterator[TokenTree]:
        for leaves in column:
            own = leaves.values
            texts, lengths, counts = (own.field(f).to_pylist() for f in ("text", "lengths", "counts")) if own is not None else ([], [], [])
            yield TokenTree(list(zip(texts, lengths, counts, strict=True)), encoder)

    return _edits_of(trees, "leaves", edits, grown, key, tokenizer, True)


def recount(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: str = "edits", tokenizer: str | None = None, keep: bool = True) -> DataFrame:
    """Trees of the documents, and the counts that their ``edits`` lead to, in one pass: see ``apply_edits``. Without ``keep`` the trees aren't given."""

    def grown(column: pa.Array, encoder: Encoder) -> Iterator[TokenTree]:
        for t in column:
            yield TokenTree.of_text(t.as_py() or "", encoder)

    return _edits_of(docs, text, edits, grown, key, tokenizer, keep)
