"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0) on a text. The votes of all documents are
counted by pattern; expectation-maximisation over those counts estimates for each rule how often its
vote is right on good and on bad documents; an abstention says nothing; a document's posterior probability of being good
follows from its pattern. The pattern table has 3^rules rows at most whatever the corpus holds, so it
fits one row's array and a broadcast.

Null, empty and blank texts have no words: all statistics are 0, ``base_failed`` holds and they are
not kept. Repeated rows and repeated ids are scored each by itself. An empty table gives an empty
result. Columns that the caller's table has besides are left alone, or ignored by ``scores``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import SPACES, cut, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ITERATIONS = 20

#: Fixed thresholds: (name, bad when, good when), over the statistics below; else the rule abstains.
RULES = [
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("repeats", "100 * n_repeat_words > 45 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    ("symbol_share", "100 * n_symbols > 5 * word_chars", "100 * n_symbols <= word_chars"),
    ("upper_case", "100 * n_upper > 20 * word_chars", "100 * n_upper <= 8 * word_chars"),
    ("letters", "100 * n_letters < 80 * word_chars", "100 * n_letters >= 91 * word_chars"),
    ("distinct_words", "100 * n_distinct < 20 * n_words", "100 * n_distinct >= 40 * n_words"),
    ("line_ends", "100 * n_ended < 50 * n_lines", "100 * n_ended >= 80 * n_lines"),
    ("word_length", "10 * word_chars > 72 * n_words OR 10 * word_chars < 28 * n_words", "10 * word_chars BETWEEN 35 * n_words AND 65 * n_words"),
    ("line_copies", "100 * n_dup_lines > 40 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
]
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"


def _neighbours(ordered: Column, same) -> Column:
    """The elements of a sorted array that equal the one before or after them."""
    either = lambda x, k: same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1))
    return F.filter(ordered, either)


def _high(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _window_keys(ws: Column, bits: Column) -> Column:
    """Sorted longs, one for each three-word window: the high bits of its hash over its place, in ``bits`` low bits."""
    hashed = lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    key = lambda i: F.call_function("shiftleft", _high(hashed(i), bits), bits).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - 3, F.lit(0))), key))


def _candidates(ws: Column, keys: Column, bits: Column) -> Column:
    """The windows whose hash bits occur twice, as (text, place), sorted; most texts have none, which one look shows."""
    place = lambda x: (x - F.call_function("shiftleft", _high(x, bits), bits)).cast("int")
    any_ = F.size(F.filter(keys, lambda x, k: _high(x, bits) == _high(F.get(keys, k + 1), bits))) > 0
    twice = F.transform(_neighbours(keys, lambda x, y: F.coalesce(_high(x, bits) == _high(y, bits), F.lit(False))), place)
    windows = F.sort_array(F.transform(twice, lambda i: F.struct(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("w"), i.alias("i"))))
    return F.when(any_, windows)


def _covered(windows: Column) -> Column:
    """Words inside the windows that stand twice or more in an array sorted by text, then place."""
    places = F.sort_array(F.transform(_neighbours(windows, lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))), lambda x: x["i"]))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """The table with a struct column ``out`` of the statistics that the rules read (replacing one of that name)."""
    t = F.coalesce(F.col(text), F.lit(""))
    arrays = docs.withColumn("__w", words(t)).withColumn("__l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    # each array has a projection of its own, so it is made once; hashes find candidates, texts decide
    arrays = arrays.withColumn("__b", F.coalesce(F.length(F.bin(F.size("__w"))), F.lit(1)))
    arrays = arrays.withColumn("__s", F.when(F.size("__w") >= 4, _window_keys(F.col("__w"), F.col("__b"))))
    arrays = arrays.withColumn("__s", _candidates(F.col("__w"), F.col("__s"), F.col("__b")))
    repeat = F.coalesce(_covered(F.col("__s")), F.lit(0))
    stats = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": repeat,
        "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "n_distinct": F.size(F.array_distinct("__w")),
        "n_ended": F.size(F.filter("__l", lambda x: F.substring(F.rtrim(x, F.lit(SPACES)), -1, 1).isin(".", "!", "?"))),
    }
    packed = F.struct(*[v.cast("long").alias(k) for k, v in stats.items()])
    # as a generator's output the statistics are made once: filters on them can't be pushed below and compute them again
    return arrays.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], F.explode(F.array(packed)).alias(out))


def with_votes(scored: DataFrame, stats: str = "stats", out: str = "votes") -> DataFrame:
    """Adds ``out``: array of each rule's vote, 1 good, -1 bad, 0 none; texts without words get no vote."""
    names = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper n_letters n_distinct n_ended".split()
    def inside(sql: str) -> str:
        return re.sub(r"\b(" + "|".join(names) + r")\b", rf"`{stats}`.\1", sql)

    one = [f"CASE WHEN `{stats}`.n_words = 0 THEN 0 WHEN {inside(bad)} THEN -1 WHEN {inside(good)} THEN 1 ELSE 0 END" for _, bad, good in RULES]
    return scored.withColumn(out, F.expr(f"array({', '.join(one)})"))


def pattern_posteriors(votes: DataFrame, column: str = "votes", rules: int | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """One row per vote pattern: ``pattern`` and ``posterior``, the probability that such a document is good.

    ``votes`` has one row per document. Counting combines map-side; what reaches one task is the
    pattern table of 3^rules rows at most. An M step estimates P(vote | class) for each rule with
    one smoothing count for each vote; an E step applies them.
    """
    k = rules or len(RULES)
    counts = votes.groupBy(F.col(column).alias("pattern")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = counts.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("rows"))
    zero = F.lit(0.0)
    started = F.transform("rows", lambda x: F.struct(x["pattern"].alias("pattern"), x["n"].alias("n"), _majority(x["pattern"]).alias("r")))
    total = lambda xs, value: F.aggregate(xs, zero, lambda a, x: a + value(x))

    def chances(xs: Column, share) -> Column:
        """log P(vote is 1 | class, no abstention) and that of -1, for each rule; share: of a row's count in the class."""
        some = lambda i, v: 1.0 + total(xs, lambda x: F.when(F.get(x["pattern"], i) == v, share(x)).otherwise(zero))
        split = lambda c: F.array(F.log(c["bad"] / (c["bad"] + c["good"])), zero, F.log(c["good"] / (c["bad"] + c["good"])))
        cells = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(some(i, -1).alias("bad"), some(i, 1).alias("good")))
        return F.transform(cells, split)

    def evidence(pattern: Column, table: Column) -> Column:
        """An abstention says nothing for either class."""
        return F.aggregate(F.zip_with(pattern, table, lambda v, p: F.get(p, v + 1)), zero, lambda a, x: a + x)

    def round_(xs: Column, _: Column) -> Column:
        good, bad = (lambda x: x["n"] * x["r"]), (lambda x: x["n"] * (1.0 - x["r"]))
        model = F.struct(chances(xs, good).alias("good"), chances(xs, bad).alias("bad"), F.log((1.0 + total(xs, good)) / (1.0 + total(xs, bad))).alias("odds"))
        # a one-element array holds the model, so the next lambda names it instead of copying it
        new = F.transform(F.array(model), lambda m: F.transform(xs, lambda x: F.struct(x["pattern"].alias("pattern"), x["n"].alias("n"), (1.0 / (1.0 + F.exp(evidence(x["pattern"], m["bad"]) - evidence(x["pattern"], m["good"]) - m["odds"]))).alias("r"))))
        return F.get(new, F.lit(0))

    fitted = rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), started, round_).alias("rows"))
    return fitted.select(F.explode("rows").alias("x")).select(F.col("x.pattern").alias("pattern"), F.col("x.r").alias("posterior"))


def _majority(pattern: Column) -> Column:
    count = lambda v: F.size(F.filter(pattern, lambda x: x == v))
    return (1.0 + count(1)) / (2.0 + count(1) + count(-1))


def with_verdicts(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with ``stats``, ``votes``, ``posterior``, ``base_failed`` and ``kept`` (columns of these names are replaced).

    Statistics are made once: the documents are written with their votes, and the votes alone are read again to be counted.
    """
    voted = cut(with_votes(with_statistics(docs.drop("stats", "votes", "posterior", "base_failed", "kept"), text)))
    posteriors = F.broadcast(pattern_posteriors(voted)).withColumnRenamed("pattern", "votes")
    joined = voted.join(posteriors, "votes", "left")
    failed = (F.col("stats.n_words") < MIN_WORDS) | (100 * F.col("stats.n_repeat_words") > 50 * F.col("stats.n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, statistics, votes, posterior, ``base_failed`` and ``kept``. Texts are read once, and what is written of them is narrow."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    voted = cut(with_votes(with_statistics(narrow, "t")).drop("t"))
    posteriors = F.broadcast(pattern_posteriors(voted)).withColumnRenamed("pattern", "votes")
    failed = (F.col("stats.n_words") < MIN_WORDS) | (100 * F.col("stats.n_repeat_words") > 50 * F.col("stats.n_words"))
    joined = voted.join(posteriors, "votes", "left").withColumn("base_failed", failed)
    return joined.select(F.col("key").alias(key), "stats", "votes", "posterior", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))
