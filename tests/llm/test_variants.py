"""Spelling variants, fingerprints and the filter audit against brute force, with odd rows, hot keys and empty tables."""

import os
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from prose import prose

from sluiceway.llm import filter_audit, queries, simhash, spelling

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
ODD = [(None, "Colour colour colour colour colour colour colours"), (None, None), (1, ""), (2, "aaaaaa aaaaaaa " * 9 + "\x00×÷ÿÿÿÿÿÿ ÀÀÀÀÀÀ àààààà"), (2, "aaaaaa " * 40), (3, "neighbour " * 60 + "neighbor " * 9 + "neighbur " * 5), (3, "neighbour " * 60 + "neighbor " * 9 + "neighbur " * 5), (5, "Ünder-STANDING understanding퟿" * 7), (6, "x" * 300_000 + " " + "y" * 6)]


def variants(n=4000, seed=3):
    """Texts of words that are edits of one another, with shared halves, doubled letters and chains."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abé", k=rng.randrange(6, 12))) for _ in range(60)]
    found = []
    for _ in range(n):
        w = rng.choice(stems[: rng.randrange(1, 60)])
        for _ in range(rng.choice((0, 0, 1, 2))):
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]))
        found += [w.upper() if rng.random() < 0.1 and w.isascii() else w] * rng.choice((1, 1, 2, 30))
    rng.shuffle(found)
    return [(i, " ".join(found[i::50])) for i in range(50)]


def groups(spark, rows):
    docs = spark.createDataFrame([(k, t, "other", 1) for k, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in spelling.groups(docs).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_variants_by_brute_force(spark, monkeypatch):
    rows = variants() + ODD
    want = plain.spellings(rows)
    assert groups(spark, rows) == want
    forms = {w: f for w, f, *_ in want}
    assert any(f is not None and forms[f] is not None for f in forms.values()) and sum(n > 2 for *_, n, _ in want) > 20
    monkeypatch.setattr(spelling, "SHARD_CHARS", 40)  # keys that go to several automata
    assert groups(spark, rows) == want
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert spelling.groups(empty).count() == 0 and groups(spark, [(1, "too rare to be words")]) == set()
    with pytest.raises(ValueError):
        spelling.groups(empty, shortest=4)


def test_one_edit():
    rng = random.Random(1)

    def slow(a, b):
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in "ab" for d in (0, 1)}
        return b in edits - {a}

    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(1, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == slow(a, b), (a, b)


@tables
def test_op11(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.queries()["op11_spelling_variants"](spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == plain.spellings(docs)


def test_fingerprints():
    for text in (None, "", " \n", "one", "One TWO", "a b c", "É é A a", prose(1, 500), "x " * 5000):
        assert simhash.fingerprint(text) == plain.fingerprint(text)
    texts = [prose(2, 70_000), "w" * 500_000]
    assert [simhash.fingerprint(t) for t in texts] == [plain.fingerprint(t) for t in texts]  # several slices


def test_masks_find_every_close_pair():
    rng = random.Random(2)
    for blocks in range(4, 9):
        masks = simhash.masks(blocks)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            assert any((a & m) == (b & m) for m in (x & (1 << 64) - 1 for x in masks))
    assert [simhash.blocks_for(n) for n in (10, 10**7, 10**11)] == sorted(simhash.blocks_for(n) for n in (10, 10**7, 10**11))


def test_edges_of_long_and_short_runs(monkeypatch):
    """Whatever the length from which runs are compared as a matrix, the components are the same; chunks compare with others only."""
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([(np.uint64(base) ^ (np.uint64(1) << rng.integers(0, 40, 30, np.uint64))) for base in rng.integers(0, 2**63, 6, np.uint64)]))
    n = len(fps)
    block = {"i": [0] * n, "j": [0] * n, "chunk": [0] * n, "tab": [0] * n, "value": pa.array((fps >> np.uint64(40)).astype(np.int64)), "fp": pa.array(fps.view(np.int64))}

    def components(edges):
        top = {int(x): int(x) for x in fps.view(np.int64)}
        for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True):
            assert int(a ^ b).bit_count() <= 3
            x, y = top[a], top[b]
            top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
        return top

    whole = components(simhash._edges(pa.table(block), 3))
    assert len(set(whole.values())) == 6
    monkeypatch.setattr(simhash, "LONG_RUN", 3)
    assert components(simhash._edges(pa.table(block), 3)) == whole
    halves = pa.table({**block, "j": [1] * n, "chunk": [k % 2 for k in range(n)]})
    own = dict(zip(block["fp"].to_pylist(), halves["chunk"].to_pylist(), strict=True))
    for limit in (3, 1000):
        monkeypatch.setattr(simhash, "LONG_RUN", limit)
        edges = simhash._edges(halves, 3)
        assert edges.num_rows and all(own[a] != own[b] for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist(), strict=True))


def test_components_by_brute_force(spark, monkeypatch):
    base = prose(1, 150)
    near = [base.replace(base.split()[i], "changed", 1) for i in range(0, 150, 5)]
    rows = [(None, base), (7, base.upper()), (7, near[0]), (None, None), (4, ""), (9, " \n"), (None, prose(50, 30)), (2, "one"), (2, "one")]
    rows += [(20 + i, t) for i, t in enumerate(near)] + [(100 + i, prose(100 + i, 40)) for i in range(20)] + [(200 + i, near[1]) for i in range(30)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, fp string").repartition(3)
    want = sorted(plain.fingerprint_components(rows), key=str)
    assert len({c for _, _, c in want}) < len(rows) - 30
    found = lambda: sorted((tuple(r)[:3] for r in simhash.near_components(docs).collect()), key=str)
    assert found() == want
    monkeypatch.setattr(simhash, "CHUNK", 4)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, d=3: 5)
    assert found() == want
    assert simhash.near_components(docs.where("false")).count() == 0


@tables
def test_op12(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.queries()["op12_simhash_near_dedup"](spark, DATA).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(plain.fingerprint_components(docs))


def test_audit_by_brute_force(spark):
    long = prose(1, 260)
    rows = [(1, None, "en"), (2, "", None), (3, "", ""), (None, "", "en"), (4, long, "en"), (5, long, "de"), (5, long, "de"), (None, long, "en"), (6, long.upper(), "en"), (7, "a b " * 150, "en"), (7, "a # b " * 150, None), (8, long + " |", "de"), (8, long + " |", "de"), (9, "É" * 900, "fr")]
    rows += [(20 + i, long, "en") for i in range(40)] + [(100 + i, prose(100 + i, 190 + i), ["en", "de"][i % 2]) for i in range(20)]
    labels = {4: (1, 0), 5: (0, 1), 7: (1, 1), 30: (1, 0), 101: (None, 1), 999: (1, 1), 8: (0, 0)}
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id bigint, text string, lang string, mask int, good boolean").repartition(3)
    said = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(4, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {tuple(r) for r in filter_audit.audit(docs, said).collect()}
    assert got == plain.audit(rows, labels) and len(got) == 4 * 600
    assert filter_audit.audit(docs.where("false"), said).count() == 0
    assert {r.good_lost for r in filter_audit.audit(docs, said.where("false")).collect()} == {0}
