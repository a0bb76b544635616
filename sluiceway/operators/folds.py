"""Folds over the ordered rows of each key: a small state is carried from row to row, and rows stream through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch are dealt out in slices of this many.
SLICE = 4096


def fold(rows: DataFrame, key: Column, order: list[Column], inputs: list[Column], start: tuple, step: Callable, name: str, kind: str) -> DataFrame:
    """The rows with a column ``name`` of the type ``kind``, made by a fold for each key in order.

    ``step(state, *inputs)`` gives the next state and the row's value; each key begins with ``start``. A task holds
    one batch and one state, whatever the size of a key's group; null is a key like any other.
    """
    own = rows.columns
    k = F.struct(key.alias("k"))
    marked = rows.withColumns({"__key": k, **{f"__in{i}": c for i, c in enumerate(inputs)}, **{f"__by{i}": c for i, c in enumerate(order)}})
    by = [f"__by{i}" for i in range(len(order))]
    dealt = marked.repartition("__key").sortWithinPartitions("__key", *by).drop(*by)
    # equal keys are neighbours: a key's change is all that the fold needs to know of it
    at = {c: i for i, c in enumerate(dealt.columns)}
    ins, mine = [at[f"__in{i}"] for i in range(len(inputs))], [at[c] for c in own]
    out = rows.limit(0).withColumn(name, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, start, True
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                made = []
                for k, *values in zip(b.column(at["__key"]).to_pylist(), *[b.column(i).to_pylist() for i in ins], strict=True):
                    if first or k != last:
                        last, state, first = k, start, False
                    state, value = step(state, *values)
                    made.append(value)
                kinds = {"bigint": pa.int64(), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in mine], pa.array(made, kinds[kind])], [*own, name])

    return dealt.mapInArrow(run, out)
