"""Quality rules, mixing, shards and licences against plain versions, with odd rows and empty tables."""

from collections import Counter, defaultdict

import plain
from pyspark.sql import functions as F

from sluiceway.llm import licenses, mixing, quality, sharding


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_quality_statistics(odd_docs, odd_rows, no_docs):
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.scores(odd_docs).select("doc_id", *[F.col(f"stats.{c}") for c in base], "base_failed", "kept").collect()
    assert ordered(r[:7] for r in got) == ordered((k, *plain.statistics(t)) for k, t, *_ in odd_rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.scores(no_docs).count() == 0
    assert quality.with_verdicts(no_docs).columns[: len(no_docs.columns) - 2]


def test_rules_are_learnt(spark):
    """Two rules that agree outvote a third that errs; all that it was told is votes."""
    votes = [([1, 1, -1],)] * 30 + [([-1, -1, 1],)] * 30 + [([1, 1, 1],)] * 10 + [([-1, -1, -1],)] * 10 + [([0, 0, 0],)] * 3
    got = {tuple(r.pattern): r.posterior for r in quality.pattern_posteriors(spark.createDataFrame(votes, "votes array<int>"), rules=3).collect()}
    assert got[(1, 1, -1)] > 0.9 and got[(-1, -1, 1)] < 0.1 and 0.2 < got[(0, 0, 0)] < 0.8


def test_mixing(spark, odd_docs, odd_rows, no_docs):
    rows = mixing.copies(odd_docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += len(plain.words(t))
    want = plain.targets(dict(sizes))
    assert ordered((r.doc_id, r.size) for r in rows) == ordered((k, len(plain.words(t))) for k, t, *_ in odd_rows)
    taken, largest = Counter(), defaultdict(int)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.copies(odd_docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert ordered(again) == ordered(rows)
    assert mixing.copies(no_docs).count() == 0 and mixing.mixed(no_docs).columns == no_docs.columns
    mix = mixing.mixed(odd_docs)
    assert mix.columns == odd_docs.columns and mix.count() == sum(r.copies for r in rows)


def test_fractions_round_in_a_tree(spark):
    """Thousands of fractions of one source: each is 0 or 1, words stay, and each rises about as often as its fraction says."""
    parts = spark.range(5000).select(F.lit("s").alias("source"), F.col("id").alias("key"), F.lit(0).alias("n"), (F.col("id") % 50 + 1).alias("size"), F.lit(0.3).alias("p"))
    got = mixing.rounded(parts, 5000).collect()
    assert len(got) == 5000 and {r.p for r in got} == {0.0, 1.0}
    assert abs(sum(r.p * r.size for r in got) - 0.3 * sum(r.size for r in got)) <= 50
    assert 1350 < sum(r.p for r in got) < 1650


def test_shards(odd_docs, odd_rows, no_docs):
    got = sharding.assign(odd_docs, 40).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert ordered((r.doc_id, r.size, r.text_crc32) for r in got) == ordered((k, size(t), plain.crc((t or "").encode())) for k, t, *_ in odd_rows)
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key"
        assert shard_of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.assign(odd_docs, 41).collect()}
    assert all(grown[k] == g for k, (_, g) in shard_of.items())
    assert sharding.assign(no_docs, 40).count() == 0


def test_shard_weights(spark):
    rows = spark.range(20_000)
    counts = Counter(r.s for r in rows.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).collect())
    assert all(abs(counts[i] / 20_000 - w / 8) < 0.02 for i, w in enumerate([1, 2, 5]))


def test_licences(spark, odd_docs, odd_rows, no_docs):
    known = licenses.default_known(spark)
    mit = (licenses.TEXTS / "MIT__1.txt").read_text()
    british = "Copyright 1999 by X\nLICENCED"
    docs = spark.createDataFrame([(1, mit.upper()), (2, mit + " more"), (3, None), (4, british), (4, british)], "doc_id int, text string")
    assert ordered((r.doc_id, r.license_id) for r in licenses.scan(docs, known).collect()) == ordered([(1, "MIT"), (2, None), (3, None), (4, None), (4, None)])
    mine = licenses.known_digests(spark.createDataFrame([("b", "the LICENSED!"), ("a", "The licenced"), ("c", " .")], "license_id string, text string"))
    assert [r.license_id for r in licenses.scan(spark.createDataFrame([(1, "the\nlicensed")], "doc_id int, text string"), mine).collect()] == ["a"]
    assert licenses.scan(odd_docs, known).count() == len(odd_rows) and licenses.scan(no_docs, known).count() == 0
    assert licenses.scan(odd_docs, known.where("false")).where("license_id is not null").count() == 0


def test_texts_in_one_paragraph(spark):
    """Copyright lines that were joined with what follows them, behind a heading or not."""
    own = "Copyright (c) 2020 Jane Doe, "
    planted = [(name, f"{head}{own}{' '.join((licenses.TEXTS / f'{name}__1.txt').read_text().split())}") for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause") for head in ("", {"MIT": "MIT License ", "ISC": "ISC License "}.get(name, ""))]
    planted += [(None, own + "all that is left is the owner"), (None, own)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(planted)], "doc_id int, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.default_known(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(planted)}


def test_every_known_licence_is_found_under_another_face(spark):
    """Each text with other letters, breaks, marks, owners, years and spellings; and each with a word more, which is none."""
    british = [("license", "licence"), ("favor", "favour"), ("organization", "organisation"), ("authorized", "authorised"), ("acknowledgment", "acknowledgement"), ("copyright owner", "copyright holder"), ("fulfill", "fulfil"), ("http:", "https:")]
    planted = []
    for k, (name, text) in enumerate(licenses.known_texts()):
        other = text.lower()
        for a, b in british:
            other = other.replace(a, b)
        planted.append((4 * k, name, text.upper()))
        planted.append((4 * k + 1, name, f"Copyright (c) 20{k:02d} Some One <a@b.c>\nCopyright 1999-2001 by Any Body\nAll rights reserved.\n\n" + other.replace(",", " ,").replace("\n", "\r\n  ")))
        planted.append((4 * k + 2, name, " ".join(text.replace('"', "``").split()) if "copyright" not in text.lower() else text + "\n\n"))
        planted.append((4 * k + 3, None, text + " Moreover"))
    docs = spark.createDataFrame([(k, t) for k, _, t in planted], "doc_id int, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.default_known(spark)).collect()}
    assert got == {k: name for k, name, _ in planted}
    assert {"Apache-2.0", "MPL-1.1", "MPL-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0", "CC0-1.0", "BSL-1.0", "MIT", "BSD-3-Clause"} <= set(got.values())


def test_hot_keys_spread(spark, monkeypatch):
    """A key, a size and a null key that hold most rows, with runs and units of few rows."""
    from sluiceway.llm import common

    monkeypatch.setattr(common, "RUN", 20)
    monkeypatch.setattr(mixing, "UNIT_ROWS", 7)
    rows = [(5, "a b c", "web")] * 90 + [(None, "x " * (i % 4), "web") for i in range(120)] + [(i, "w " * (i % 9), ["web", "books", None][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = sharding.assign(docs, 3).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    taken = mixing.copies(docs).collect()
    want = Counter((r.doc_id, r.source, r.size, r.copies) for r in taken)
    assert Counter((r.doc_id, r.source, r.size) for r in taken) == Counter((k, s, len(t.split())) for k, t, s in rows)
    sizes, words, largest = Counter(), Counter(), Counter()
    for r in taken:
        sizes[r.source] += r.size
        words[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    goal = plain.targets(dict(sizes))
    assert all(abs(words[s] - goal[s]) <= largest[s] for s in goal)
    mix = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed(docs).collect())
    assert mix == +Counter({u: sum(n * c for (*v, c), n in want.items() if tuple(v) == u) for u in {k[:3] for k in want}})


def test_hot_joins_lose_nothing(spark):
    from sluiceway.llm import common

    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    found = common.spread_join(rows, per, "k", "n", 6000, "v")
    assert ordered(found.select("k", "v", "n", "s").collect()) == ordered(rows.join(per, "k").select("k", "v", "n", "s").collect())


def test_a_large_document_does_not_spoil_the_mix(spark):
    """One document of half a source's words, and sources of one size alone: the words taken differ by a small document from the target."""
    from sluiceway.llm import mixing

    rows = [(0, "a", 20_000)] + [(i, "a", 20 + i % 60) for i in range(1, 400)] + [(1000 + i, "b", 7) for i in range(300)] + [(2000 + i, "c", 1 + 40 * (i % 90)) for i in range(900)]
    docs = spark.createDataFrame([(k, s, "w " * n) for k, s, n in rows], "doc_id bigint, source string, text string").repartition(4)
    for seed in range(3):
        got = mixing.copies(docs, seed=seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()
        assert {r.source: r.n for r in got} == {"a": 400, "b": 300, "c": 900}
        assert all(abs(r.taken - r.target) <= {"a": 80, "b": 7, "c": 3561}[r.source] for r in got)
        assert all(abs(r.taken - r.target) <= r.target / 100 for r in got)
