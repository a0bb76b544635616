"""Audit of how filters interact, over all orders in which they can be applied.

Each document has a mask: one bit for each filter that it fails. Documents are counted by mask, part and labels, and
all figures come from these cells. The cells are laid out in long form, one row for each order and step; a running
bit-or over the steps of an order says what a cell failed before, conditional sums give the figures of a step, and a
window over all steps of a filter adds up what it removes in all orders.

The filters are conditions on a row and, last of all, copies: a document fails where a smaller key has the same text, in
any part and whether or not that one is removed. Texts are known by their SHA-256. Copies of one text are aggregated by part and
label before they meet, so a text that a third of all rows share is few rows; keys that many rows have are joined in parts.

Null texts are empty texts, a null part is the empty string. A null key is neither smaller nor larger than another, so such rows are
no copies and make none; rows of one key and one text are no copies of each other. A document is good or toxic if any label of its key says so; null keys have none.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import cut, spread_join, words

# The thresholds of the audit's filters.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
COPY = "E"


def conditions(text: Column) -> dict[str, Column]:
    """Letter to the condition under which a text fails: few words, few different ones, many capitals, symbols."""
    w = words(text)
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < FEWEST_WORDS, "B": 100 * distinct < LEAST_DISTINCT * n, "C": 100 * capitals > MOST_CAPITALS * F.char_length(text), "D": text.rlike(SYMBOLS)}


def mask_cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents counted by part and mask: part, mask, n, good and toxic (documents that a label says are)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("text")).values())]
    copy = 1 << len(bits)
    # the text is read once; what goes on is its digest
    narrow = rows.select("key", "part", F.sha2("text", 256).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    same = cut(narrow.groupBy("key", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    flags = labels.select(F.col(key).alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    flags = flags.where("key IS NOT NULL AND (good OR toxic)").groupBy("key").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    per_key = flags.join(same.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    labelled = spread_join(same, per_key, "key", "rows", same.count(), "digest", "left").fillna(False, ["good", "toxic"])
    # copies of a text in one part with one kind of label: how many, and how many have the least key or none
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n")))
    kinds = labelled.groupBy("digest", "part", "mask", "good", "toxic", "key").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    # few rows for each text by now: one for each part and kind of label
    first = F.min("least.key").over(Window.partitionBy("digest"))
    counted = kinds.withColumn("firsts", F.col("unnamed") + F.when(F.col("least.key") == first, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    cells = counted.select("part", "good", "toxic", both.alias("c")).select("part", "good", "toxic", "c.mask", "c.n")
    sums = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    return cells.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(name) for name, c in sums.items()])


def interactions(cells: DataFrame, filters: str) -> DataFrame:
    """Cells (part, mask, n, good, toxic) to one row for each part, order of the filters and step.

    Columns: part, filter_order, step (from 1), and counts of documents: kept (after the step), removed (by it), redundant (failing its
    filter but removed before), unique_fails (failing its filter only), good_lost, toxic_lost (removed here), shapley (removed by the filter, summed over all orders).
    """
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)])).alias("filter_order")  # n! of them, by the number of filters alone
    step = F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    # a part has 2^n cells at most, so the long form has a fixed number of rows for each part
    long = cells.select("*", orders).select("*", step).withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)"))
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    here, gone = (F.col("fails") != 0) & (F.col("earlier") == 0), F.col("earlier") != 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")
    per_step = long.groupBy("part", "filter_order", "step", "filter").agg(
        total((F.col("fails") == 0) & ~gone).alias("kept"),
        total(here).alias("removed"),
        total((F.col("fails") != 0) & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return per_step.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The figures of ``interactions`` for the filters A to E over documents and their labels (key, quality, toxic)."""
    return interactions(mask_cells(docs, labels, key, text, part), "".join(conditions(F.lit(""))) + COPY)
