"""Rows of null and of repeated keys are told apart."""

from prose import prose

import corpus_pipeline
from sluiceway.llm import decontam, ngram_join


def near(text, word):
    return text.replace(text.split()[60], word, 1)


def test_near_copies_of_null_and_repeated_keys(spark):
    a, b, c = prose(1, 120), prose(2, 120), prose(3, 120)
    rows = [(None, a), (None, near(a, "one")), (None, near(a, "one")), (None, b), (3, c), (5, near(c, "two")), (5, prose(4, 120)), (None, near(c, "three"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    links = sorted((r.n_links, r.class_id or 0) for r in ngram_join.near_groups(docs).collect())
    assert links == sorted([(2, 0)] * 3 + [(0, 0)] + [(2, 3)] * 3 + [(0, 5)])
    kept = [tuple(r) for r in ngram_join.one_of_each(docs).select("doc_id", "text").collect()]
    assert len(kept) == 4 and sum(t in (a, near(a, "one")) for _, t in kept) == 1
    assert {(None, b), (3, c), (5, prose(4, 120))} < set(kept)


def test_decontamination_of_null_and_repeated_keys(spark, tmp_path):
    test = prose(7, 30)
    spark.createDataFrame([(1, test)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, dirty = [prose(8, 60), prose(9, 60)], [f"{prose(10, 40)} {test}", f"{prose(11, 40)} {test}"]
    docs = spark.createDataFrame([(None, dirty[0]), (5, dirty[1]), (5, clean[0]), (None, clean[1]), (None, None)], "doc_id bigint, text string")
    left = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(5, clean[0]), (None, clean[1]), (None, None)], key=str)


def test_several_blocks_of_tests_and_repeated_keys(spark, monkeypatch):
    tests = [(i, prose(20 + i, 30)) for i in range(6)]
    rows = [(5, f"{prose(30, 40)} {tests[0][1]}"), (5, prose(31, 70)), (None, f"{tests[3][1]} {prose(32, 40)}"), (None, prose(33, 70)), (5, prose(31, 70))]
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")
    found = lambda: sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(docs, items).collect())
    want = found()
    assert [x[-1] for x in want].count(True) == 2
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    assert found() == want


def test_quality_stage_keeps_the_callers_columns(spark):
    names = ["stats", "votes", "posterior", "base_failed", "kept"]
    rows = [(i, prose(40 + i, 80), *[f"{c}-{i}" for c in names]) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    left = corpus_pipeline.quality_rules(spark, docs, "")
    found = [tuple(r) for r in left.collect()]
    assert left.columns == docs.columns and found and set(found) <= set(rows)


def test_stages_keep_columns_that_have_our_private_names(spark, tmp_path):
    """Every name that an operator gives a column inside, as a column of the caller's: all come back as they were."""
    names = "__f __i __row __copies __copy __rank __run __part __parts __hot __piece __start __at __n row key own unit n more whole size units set_id root rep bands digest at f p block copies".split()
    test = prose(7, 30)
    spark.createDataFrame([(1, test)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [prose(300 + i, 90) + "." for i in range(12)]
    texts += [near(texts[0], "changed"), texts[1], f"{prose(400, 60)}. {test} end."]
    rows = [(i, t, "en", ["web", "books"][i % 2], len(t), *[f"{c}-{i}" if c not in ("__i", "n", "size") else 7 for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names]).repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for given in (docs, stored):  # rows with and without places in files
        left = {}
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, given, str(tmp_path))
            got = [tuple(r) for r in out.collect()]
            assert out.columns == docs.columns and got and set(got) <= set(rows), name
            left[name] = len(got)
        assert left["n-gram Jaccard join"] == len(rows) - 2 and left["benchmark decontamination"] == len(rows) - 1
        assert len(ngram_join.near_groups(given).collect()) == len(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_decontamination_of_keys_of_other_types(spark):
    from pyspark.sql import functions as F

    test = prose(7, 30)
    rows = spark.createDataFrame([(1, f"{prose(8, 40)} {test}"), (2, prose(9, 60))], "k bigint, text string")
    items = spark.createDataFrame([(1, test)], "item_id bigint, text string")
    for key in (F.col("k").cast("double"), F.col("k").cast("decimal(10,2)"), F.timestamp_seconds("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int")), F.col("k").cast("string").cast("binary")):
        docs = rows.select(key.alias("doc_id"), "text", "k")
        found = decontam.contamination(docs, items).collect()
        named = {bytes(r.doc_id) if isinstance(r.doc_id, bytearray) else r.doc_id: r.k for r in docs.collect()}
        assert {named[bytes(r.doc_id) if isinstance(r.doc_id, bytearray) else r.doc_id]: r.contaminated for r in found} == {1: True, 2: False}


def test_pipeline_of_null_and_repeated_keys(spark, tmp_path):
    """All stages over rows whose keys say nothing, against plain versions that know rows by their places."""
    from collections import Counter

    import duckdb
    import plain

    from sluiceway.llm import sql

    test = prose(90, 30)
    texts = [prose(100 + i, 90) + "." for i in range(24)]
    rows = []
    for i, t in enumerate(texts):
        rows += [(None if i % 2 else 5, t, "en", ["web", "books", None][i % 3], len(t))] * (1 + i % 3)
        if i % 4 == 0:
            rows.append((None if i % 3 else 5, near(t, "changed"), "en", "web", len(t)))
        if i % 6 == 1:
            rows.append((5, f"{prose(200 + i, 60)}. {test} end.", "en", "books", 0))
    rows += [(5, None, "en", "web", 0), (None, "", None, None, 0), (None, "too short", "en", "web", 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(i, r[1]) for i, r in enumerate(rows)])
    good = [rows[i] for (i,) in c.execute(f"WITH {sql.quality_ctes()} SELECT doc_id FROM scored WHERE kept ORDER BY doc_id").fetchall()]
    assert 0 < len(good) < len(rows)
    groups = plain.groups([(i, r[1]) for i, r in enumerate(good)])
    left = [r for i, r in enumerate(good) if groups[i][0] == i]  # one row for each group, whichever
    clean = [r for r in left if not plain.hits(r[1], [(1, test)])[1]]
    assert len(clean) < len(left)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.doc_id in (5, None) for r in got) and len({(r.shard, r.slot) for r in got}) == len(got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept.count(), corpus_pipeline.cut(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns and kept.count() < before, name
    own = Counter(plain.shingles(r.text) for r in kept.collect())
    assert len(own) == len(clean) and not any(plain.hits(r.text, [(1, test)])[1] for r in kept.collect())
    # each group that is left has a row with its smallest key, where it has a key
    by_place = {groups[i][0]: [good[j] for j in range(len(good)) if groups[j][0] == groups[i][0]] for i in range(len(good))}
    for r in kept.collect():
        group = next(g for g in by_place.values() if any(x[1] == r.text for x in g))
        assert r.doc_id == min((x[0] for x in group if x[0] is not None), default=None)
    mix = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.source_mixing(spark, kept, "").collect())
    per = Counter()
    for r in kept.collect():
        per[r.source] += len(r.text.split())
    for s, goal in plain.targets(dict(per)).items():
        assert abs(sum(n * len(t.split()) for (_, t, x), n in mix.items() if x == s) - goal) <= 120
