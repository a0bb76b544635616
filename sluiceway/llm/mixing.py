"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source with size S and target T is wanted T / S times. The whole part is taken as it
is; the fraction p is rounded to 0 or 1. Fractions meet in pairs: mass (words, that is p times the
document's size) moves from one to the other, in a random direction whose odds keep both expectations,
until one of the two is integral. Each pair keeps its words in sum, so a source's words stay at
its target but for the one fraction that is left at the end, which is rounded to the nearer side.

The largest documents are settled first, each against all smaller ones together: the mass that it gains or loses comes from or goes to them by the same rule, so
what is left for the pairs are documents of 1 / LARGE of the source at most, and the last fraction is one of the smallest.
No source has more than LARGE documents that are larger, so one fold settles them, however many rows it has.

Rows of one key, source and size are one unit of the rounding: of n such rows, floor(n p) are taken once more, and
what is left of n p is the unit's fraction. So no key, null among them, is more than a few units, however many rows it has.

Pairs meet in a reduction tree: a block of units folds into decisions and one residual at most,
blocks of residuals fold again. Blocks are dealt by a hash of the key and size, never by source alone, so a hot
source spreads over as many blocks as its rows need.

Null texts have size 0; rows of size 0 add no words, so their units are rounded each by itself. Null sources are a source
of their own, the last. Repeated rows count each by itself. An empty
table gives an empty result. A table with other columns is fine: only key, source and text are read.
Random numbers are hashes of key, size and seed, so reruns agree. Targets take one row for each source in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import cut, identified, numbered, of_row, ranked, spread_join, words

FAN_IN = 64
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
LARGE = 1000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: ``source_size``, ``weight`` and ``target``, from rows (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn. Targets share the sum of sizes
    by weight; a target above ``most`` times its source's size stops there, and the rest is shared
    again until none is above. In order of cap over weight, a source is capped as long as its cap is
    below its share of what the earlier ones left: that order finds the same targets in one pass.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(turn) - 1) % len(weights) + 1).cast("long"))
    per = per.withColumn("cap", most * F.col("source_size"))
    early = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = early.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("left", left).withColumn("heavy", heavy).withColumn("capped", F.col("cap") * F.col("heavy") <= F.col("weight") * F.col("left"))
    # behind the capped ones, all sources share what the last capped one left
    per = per.withColumn("place", F.row_number().over(early))
    shared = F.min_by(F.struct("left", "heavy"), F.when(~F.col("capped"), F.col("place"))).over(whole)
    per = per.withColumn("shared", shared)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("shared.left") / F.col("shared.heavy"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / F.lit(float(1 << 53))


def _fold(units: Column, key_type: str, seed: int) -> Column:
    """Folds units (key, n, size, p), in their order, to (done: decided units, held: the one fractional unit or null).

    Of the held unit a and the next one b, with masses in words: either a takes from b, or b from a,
    as much as makes one of them integral. The odds are inverse to the amounts, so both keep their expectation.
    """
    eps = 1e-9
    unit = f"struct<key:{key_type},n:bigint,size:bigint,p:double>"
    start = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.lit(None).cast(unit).alias("held"))

    def moved(x: Column, p: Column) -> Column:
        clean = F.when(p <= eps, 0.0).when(p >= 1 - eps, 1.0).otherwise(p)
        return F.struct(x["key"].alias("key"), x["n"].alias("n"), x["size"].alias("size"), clean.alias("p"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["held"]
        sa, sb = [x["size"].cast("double") for x in (a, b)]
        up = F.least((1 - a["p"]) * sa, b["p"] * sb)
        down = F.least(a["p"] * sa, (1 - b["p"]) * sb)
        rises = _uniform(a["key"], a["size"], b["key"], b["size"], F.lit(seed)) * (up + down) < down
        amount = F.when(rises, up).otherwise(-down)
        pair = F.array(moved(a, a["p"] + amount / sa), moved(b, b["p"] - amount / sb))
        integral = lambda x: (x["p"] <= 0) | (x["p"] >= 1)
        met = F.transform(F.array(pair), lambda q: F.struct(F.concat(acc["done"], F.filter(q, integral)).alias("done"), F.get(F.filter(q, lambda x: ~integral(x)), F.lit(0)).alias("held")))
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.alias("held"))).otherwise(F.get(met, F.lit(0)))

    return F.aggregate(units, start, step)


def _settle(units: Column, seed: int) -> Column:
    """Folds units (key, n, size, p, mass and capacity of the source), largest first, to (done: the units with new p, scale and shift).

    Each unit meets the pool of all smaller ones as a pair of one unit would: it becomes integral, and the pool's p become
    scale * p + shift, smaller or nearer to 1 alike. If the pool has less to give than that, it becomes integral and the unit stays as it is.
    """
    start = F.struct(F.transform(units, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"), x["size"].alias("size"), x["p"].alias("p"))).alias("done"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("room"))
    none = F.struct(F.filter(start["done"], lambda x: F.lit(False)).alias("done"), start["scale"].alias("scale"), start["shift"].alias("shift"), F.get(units, F.lit(0))["mass"].alias("mass"), F.get(units, F.lit(0))["capacity"].alias("room"))

    def clean(p: Column) -> Column:
        return F.when(p <= 1e-9, 0.0).when(p >= 1 - 1e-9, 1.0).otherwise(p)

    def met(acc: Column, a: Column) -> Column:
        size = a["size"].cast("double")
        p = F.least(F.greatest(acc["scale"] * a["p"] + acc["shift"], F.lit(0.0)), F.lit(1.0))
        # the pool without this unit: its mass, and how much it could hold
        return F.struct(a.alias("a"), size.alias("size"), p.alias("p"), F.greatest(acc["mass"] - p * size, F.lit(0.0)).alias("mass"), F.greatest(acc["room"] - size, F.lit(0.0)).alias("room"))

    def moved(acc: Column, x: Column) -> Column:
        up = F.least((1 - x["p"]) * x["size"], x["mass"])
        down = F.least(x["p"] * x["size"], F.greatest(x["room"] - x["mass"], F.lit(0.0)))
        rises = _uniform(x["a"]["key"], x["a"]["size"], F.lit(seed)) * (up + down) < down
        amount = F.when(rises, up).otherwise(-down)
        less = F.coalesce(F.try_divide(x["mass"] - up, x["mass"]), F.lit(1.0))
        more = F.coalesce(F.try_divide(x["room"] - x["mass"] - down, x["room"] - x["mass"]), F.lit(1.0))
        unit = F.struct(x["a"]["key"].alias("key"), x["a"]["n"].alias("n"), x["a"]["size"].alias("size"), clean(x["p"] + amount / x["size"]).alias("p"))
        return F.struct(
            F.concat(acc["done"], F.array(unit)).alias("done"),
            F.when(rises, acc["scale"] * less).otherwise(acc["scale"] * more).alias("scale"),
            F.when(rises, acc["shift"] * less).otherwise(acc["shift"] * more + 1 - more).alias("shift"),
            (x["mass"] - amount).alias("mass"),
            x["room"].alias("room"),
        )

    def step(acc: Column, a: Column) -> Column:
        return F.get(F.transform(F.array(met(acc, a)), lambda x: moved(acc, x)), F.lit(0))

    return F.aggregate(units, none, step)


def settled(fractions: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Units (source, key, n, size, p) to those that are decided, p 0 or 1, and to those that are left, with new p between."""
    per = fractions.groupBy("source").agg(F.sum("size").cast("double").alias("capacity"), F.sum(F.col("p") * F.col("size")).alias("mass")).withColumnRenamed("source", "s")
    rows = cut(fractions.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("large", F.col("size") * LARGE >= F.col("capacity")))
    unit = F.struct((-F.col("size")).alias("s"), F.xxhash64("key", "size").alias("h"), "key", "n", "size", "p", "mass", "capacity")
    lists = rows.where("large").groupBy("source").agg(F.sort_array(F.collect_list(unit)).alias("o"))
    folded = cut(lists.select("source", _settle(F.col("o"), seed).alias("f")))
    done = folded.select("source", F.inline("f.done")).withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    state = folded.select(F.col("source").alias("s"), "f.scale", "f.shift")
    p = F.coalesce("scale", F.lit(1.0)) * F.col("p") + F.coalesce("shift", F.lit(0.0))
    left = rows.where("NOT large").join(state, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("p", F.when(p <= 1e-9, 0.0).when(p >= 1 - 1e-9, 1.0).otherwise(p)).select("source", "key", "n", "size", "p")
    between = (F.col("p") > 0) & (F.col("p") < 1)
    return done.unionByName(left.where(~between)), cut(left.where(between))


def rounded(fractions: DataFrame, total_units: int, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Units (source, key, n, size, p with 0 < p < 1; sizes above 0, key and size distinct in a source) to the same with p 0 or 1.

    Level 0 folds blocks of about ``fan_in`` units, by source, largest sizes first, which keeps the
    masses that meet alike. Each later level folds the residuals of ``fan_in`` blocks; the number of
    levels is the logarithm of the unit count. A level's narrow rows are written before the next reads them.
    """
    key_type = fractions.schema["key"].dataType.simpleString()
    blocks = max(1, -(-total_units // fan_in))
    level = fractions.select("source", "key", F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"), "p", F.pmod(F.xxhash64("key", "size", F.lit(seed)), F.lit(blocks)).alias("block"))
    decided, depth = [], 0
    while True:
        order = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), F.xxhash64("key", "size").alias("h"), "key", "n", "size", "p")))
        folded = cut(level.groupBy("source", "block").agg(order.alias("o")).select("source", "block", _units("o").alias("units")).select("source", "block", _fold(F.col("units"), key_type, seed + depth).alias("f")))
        decided.append(folded.select("source", F.inline("f.done")))
        level = folded.where("f.held IS NOT NULL").select("source", "f.held.*", F.floor(F.col("block") / fan_in).alias("block"))
        if blocks == 1:
            break
        blocks, depth = -(-blocks // fan_in), depth + 1
    decided.append(level.drop("block").withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def _units(column: str) -> Column:
    return F.transform(column, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"), x["size"].alias("size"), x["p"].alias("p")))


def _decided(sized: DataFrame, seed: int) -> DataFrame:
    """Of written rows (key, source, size) the units: key, source, size, n (rows), source_size, target, whole (copies of each row) and more (rows with one copy more)."""
    targets = source_targets(sized).withColumnRenamed("source", "s")
    want = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    units = sized.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = units.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight").withColumn("want", want).withColumn("whole", F.floor(F.col("want") + 1e-9))
    units = units.withColumn("up", F.col("n") * F.greatest(F.col("want") - F.col("whole"), F.lit(0.0)))
    units = cut(units.withColumn("more", F.floor(F.col("up") + 1e-9)).withColumn("p", F.greatest(F.col("up") - F.col("more"), F.lit(0.0))).drop("want", "up"))
    loose = (F.col("p") > 1e-9) & (F.col("size") > 0)
    first, fraction = settled(units.where(loose).select("source", "key", "n", "size", "p"), seed)
    done = first.unionByName(rounded(fraction, fraction.count(), seed).select(first.columns)).withColumnsRenamed({"source": "s"})
    per = units.groupBy("source").agg(*[F.any_value(c).alias(c) for c in ("source_size", "target", "whole")])
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) - F.col("whole")
    done = done.join(per, F.col("s").eqNullSafe(F.col("source"))).withColumn("more", F.floor(F.col("n") * share + 1e-9) + F.col("p").cast("long"))
    rest = units.where(~loose).withColumn("more", F.col("more") + F.when(_uniform(F.col("key"), F.col("source"), F.lit(seed)) < F.col("p"), 1).otherwise(0))
    cols = ["key", "source", "size", "n", "source_size", "target", "whole", "more"]
    return done.select(cols).unionByName(rest.select(cols))


#: Rows of one unit that one task writes at most.
UNIT_ROWS = 1000


def copies(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """Per document: key, source, size, source_size, target and ``copies``, how often the mix takes it (0 to 3)."""
    units = cut(_decided(_sized(docs, key, source, text), seed))
    few = units.where(F.col("n") <= UNIT_ROWS).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = units.where(F.col("n") > UNIT_ROWS).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(UNIT_ROWS).cast("long")))).repartition("key", "size", "first")
    many = many.withColumn("nth", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + UNIT_ROWS, F.col("n")) - 1))).drop("first")
    taken = F.col("whole") + F.when(F.col("nth") < F.col("more"), 1).otherwise(0)
    return few.unionByName(many).select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("copies"))


def _sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size")))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the caller's columns."""
    named = identified(docs)
    unit = F.struct(of_row(key).alias("key"), of_row(source).alias("source"), F.size(words(of_row(text))).cast("long").alias("size"))
    rows = numbered(named.select("__f", "__i", unit.alias("unit")))
    total = rows.count()
    units = _decided(rows.select("unit.*"), seed).select(F.struct("key", "source", "size").alias("unit"), "n", "whole", "more")
    known = spread_join(rows, units, "unit", "n", total, "__row")
    alone = known.where("n = 1").withColumn("__rank", F.lit(0).cast("long"))
    several = ranked(cut(known.where("n > 1")), ["unit"], ["unit"], total)
    taken = alone.unionByName(several).select("__f", "__i", (F.col("whole") + F.when(F.col("__rank") < F.col("more"), 1).otherwise(0)).cast("int").alias("__copies")).where("__copies > 0")
    return named.join(taken, ["__f", "__i"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")
