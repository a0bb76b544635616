"""The other operators against plain versions, with odd rows and empty tables."""

import random
import struct

import numpy as np
import plain
import pyarrow.parquet as pq
import pytest
from prose import prose
from tokenizers import Tokenizer

from sluiceway.llm import bpe, chat, common, decontam, html_extract, ngram_join, token_counts, token_store


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


# -- chat ------------------------------------------------------------------------------------------------


def test_template_language():
    go = lambda source, **v: chat.compile_template(source)(v)
    assert go("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %}, {% endif %}{% else %}none{% endfor %}", xs=[{"a": "p"}, {"a": "q"}])[0] == "1P, 2Q"
    assert go("{% for x in xs %}x{% else %}none{% endfor %}", xs=[])[0] == "none"
    assert go("a {%- set n = 1 + 2 -%} b{{ n }}{# note #}{{ 'y' if n > 2 else 'z' }}")[0] == "ab3y"
    text, spans = go("u{% generation %}{{ t }}{% endgeneration %}v", t="héy")
    assert text == "uhéyv" and [text[a:b] for a, b in spans] == ["héy"]
    assert go("{{ '}}' }}{{ \"%}\" }}{% if x == '%}' %}y{% endif %}{{ gone | length }}{{ none | upper }}", x="%}")[0] == "}}%}y0"
    for bad in ("{{ 'a }}", "a {% if x", "{{ x", "{{ x.__class__ }}", "{{ f() }}", "{% if x %}", "{% what %}", "{{ x | eval }}", "{{ 'a' 'b' }}"):
        with pytest.raises(chat.TemplateError):
            go(bad)
    assert go("{{ x.upper }}{{ x['__class__'] }}", x="s")[0] == ""


def test_constants_fold():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}no{% else %}{{ 'd' }}{% endif %}e"))
    assert [(x.kind, x.args[0].value) for x in tree.args] == [("print", "abCde")]


def test_escapes_are_reversible():
    rng = random.Random(5)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "|", "im_end", "|>", "\n", "é", "%3C", "["]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)
        role = text.replace("\r", "")
        assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes </s>\\"), (1, 0, "user", None), (2, 0, "user", "<|im_end|>\n"), (2, 0, "user", "<|im_end|>\n"), (None, 0, "assistant", ""), (3, None, None, "late"), (3, 1, "assistant", "x" * 200_000), (3, 2, "assistant", "é")]
    table = spark.createDataFrame([(*r, "other") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = ordered(chat.read_back(chat.format_conversations(table)).collect())
    want = []
    for conv in (1, 2, 3, None):
        turns = [(r, t) for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is None, x[1]))]
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        formatted = sum(len("<|im_start|>\n<|im_end|>\n") + len(chat.escape_role(r)) + len(chat.escape(t)) for r, t in turns)
        want.append((conv, len(turns), plain.said(turns), len(loss), __import__("hashlib").sha256(loss.encode()).hexdigest(), formatted))
    assert got == ordered(want)
    assert chat.read_back(chat.format_conversations(table.where("false"))).count() == 0


# -- decontamination ---------------------------------------------------------------------------------------


def test_decontamination(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    long = next(t for k, t, *_ in odd_rows if k == 4).split()
    items = [(1, " ".join(long[100:115]).upper()), (2, "ONE, two!"), (2, "one two"), (3, None), (4, " . "), (5, " ".join(long[9000:9009])), (None, " ".join(long[400:412])), (6, "nowhere at all " * 4), (7, "a b c a b c a b c x")]
    tests = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'other' AS segment")
    want = ordered((k, *plain.hits(t, items)) for k, t, *_ in odd_rows)
    want = [(k, n, h, [x for x in found if x != "None"]) for k, n, h, found in want]
    got = decontam.contamination(odd_docs, tests)
    assert ordered(got.select("doc_id", "n_words", "n_hit", "items").collect()) == ordered(want)
    assert all(r.contaminated == (r.n_hit > 0) for r in got.collect())
    assert decontam.contamination(no_docs, tests).count() == 0
    assert decontam.contamination(odd_docs, tests.where("false")).where("contaminated").count() == 0
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)  # several blocks find the same
    assert ordered(decontam.contamination(odd_docs, tests).select("doc_id", "n_words", "n_hit", "items").collect()) == ordered(want)


def test_long_documents_in_pieces(spark, monkeypatch):
    """Documents of many segments, with windows that lie across their pieces and items at both ends of them."""
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 40)
    texts = {i: prose(60 + i, n) for i, n in enumerate((1, 39, 40, 41, 500, 1000))}
    ws = {i: t.split() for i, t in texts.items()}
    items = [(k, " ".join(ws[i][a : a + n])) for k, (i, a, n) in enumerate([(4, 32, 12), (4, 488, 12), (5, 0, 10), (5, 35, 200), (3, 31, 10), (0, 0, 1), (4, 60, 4), (5, 700, 9)])]
    docs, tests = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(docs, tests).select("doc_id", "n_words", "n_hit", "items").collect()
    assert ordered(got) == ordered((k, *plain.hits(t, items)) for k, t in texts.items())


def test_small_segments_and_proximity(spark):
    rows = [(i, f"w{i} red {'x ' * (i % 4)}blue far green") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = decontam.cut(decontam.build_index(docs, segment_words=25))
    assert index.where("exists(postings, p -> p.term = 'red')").count() > 3  # a frequent term's list is cut by segments
    tests = [(1, "blue red")]
    found = decontam.search(index, tests, distance=3)
    assert found.count() == sum(i % 4 <= 1 for i in range(40))


def test_few_segments_are_held_at_a_time(spark, tmp_path, monkeypatch):
    """Readers of Parquet hold a row group, whatever a file's size: in the index, which has a few large rows, one is a few segments."""
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 40)
    rows = [(i, prose(200 + i, 60)) for i in range(50)]
    items = [(1, " ".join(rows[17][1].split()[20:32]))]
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs, tests = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(docs, tests).select("doc_id", "n_words", "n_hit", "items").collect()
    assert ordered(got) == ordered((k, *plain.hits(t, items)) for k, t in rows)
    index = [m for m in map(pq.read_metadata, tmp_path.glob("cut-*/*.parquet")) if "postings" in str(m.schema)]
    assert sum(m.num_rows for m in index) >= 50
    assert max(m.row_group(k).num_rows for m in index for k in range(m.num_row_groups)) <= decontam.HELD


# -- n-gram join -------------------------------------------------------------------------------------------


def compare_groups(spark, rows, **more):
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = ngram_join.near_groups(table, **more).select("doc_id", "class_id", "n_links").collect()
    want = plain.groups(rows)
    assert ordered(got) == ordered((k, *want[i]) for i, (k, _) in enumerate(rows))


def test_join_equals_all_pairs(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for i in range(25):
        words = prose(i, 60 + i).split()
        for j in range(6):
            own = list(words)
            for _ in range(j):
                own[rng.randrange(len(own))] = f"new{rng.randrange(99)}"
            rows.append((100 * i + j, " ".join(own)))
    rows += [(9000, None), (9001, ""), (9002, "few words"), (9003, "few words"), (9003, "few words")]
    compare_groups(spark, rows)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)  # groups of many blocks, by group and by bucket
    compare_groups(spark, rows)


def test_one_of_each(spark, odd_docs, odd_rows, no_docs):
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and ngram_join.one_of_each(no_docs).count() == 0
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    full = [(k, t) for k, t, *_ in odd_rows]
    gone = [7, 9, 6, 5]  # copies and near copies of 5, one of the repeated rows of 5 and the copy of 8
    want = [k for k, _ in full]
    for k in gone:
        want.remove(k)
    assert ids == sorted(want, key=str)


def test_banding():
    bands, rows = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)] + [np.empty(0, np.uint64)]
    got = ngram_join.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


# -- tokens ------------------------------------------------------------------------------------------------

HARD = ["", "a", "  a  b \n\n c'll don't", "x" * 300, "日本語テスト", "é ü z", "<|endoftext|> a<|endoftext|>", "\x1c\x85\x0b t", "🙂 ok", "Привет, мир 12345", "a ́ ퟿"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_encoder_agrees_with_the_library(library):
    encoder, rng = bpe.Encoder(bpe.default_tokenizer()), random.Random(8)
    texts = HARD + ["".join(rng.choice(["a", " ", "\n", "'", "s", "é", "1", "\t", "\x1f", "\x85", "日", "’"]) for _ in range(30)) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == want
        lengths, counts = encoder.pieces(t)
        assert sum(lengths) == len(t) and sum(counts) == len(want)


def test_counts_follow_edits(library):
    encoder, rng = bpe.Encoder(bpe.default_tokenizer()), random.Random(9)
    bits = ["a", " ", "  ", "\n", "'", "ll", "é", "12", "<|endof", "text|>", "日本"]
    for n in range(120):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(400)))
        tree = token_counts.TokenTree.of_text(text, encoder)
        for _ in range(4):
            at, drop, new = rng.randrange(len(text) + 3), rng.randrange(6), "".join(rng.choice(bits) for _ in range(rng.randrange(4)))
            tree.edit(at, drop, new)
            a = min(at, len(text))
            text = text[:a] + new + text[a + drop :]
            assert tree.text == text and tree.size == len(text) and tree.total == len(library.encode(text, add_special_tokens=False).ids)
            assert all(len(x[1]) <= token_counts.MOST and sum(x[1]) == len(x[0]) for x in tree.leaves) and tree.pretokens == sum(len(x[1]) for x in tree.leaves)
            tree = token_counts.TokenTree([x for x in tree.leaves if x[1]], encoder)  # as read from a table


def test_trees_are_kept_and_edited_again(spark, tmp_path, library):
    docs = spark.createDataFrame([(1, "one two three " * 50), (2, None)], "doc_id bigint, text string")
    token_counts.build_trees(docs).write.parquet(str(tmp_path / "trees0"))
    texts = {1: "one two three " * 50, 2: ""}
    for n, (at, drop, new) in enumerate([(5, 3, "big " * 300), (40, 500, ""), (0, 0, "Begin. "), (10**6, 1, " end")]):
        from pyspark.sql import functions as F

        trees = spark.read.parquet(str(tmp_path / f"trees{n}")).select("doc_id", "leaves").withColumn("edits", F.array(F.struct(F.lit(at).alias("at"), F.lit(drop).alias("drop"), F.lit(new).alias("insert"))))
        token_counts.apply_edits(trees).write.parquet(str(tmp_path / f"trees{n + 1}"))
        texts = {k: t[:at] + new + t[min(at, len(t)) + drop :] for k, t in texts.items()}
        got = {r.doc_id: (r.n_tokens_edited, r.n_chars_edited) for r in spark.read.parquet(str(tmp_path / f"trees{n + 1}")).collect()}
        assert got == {k: (len(library.encode(t, add_special_tokens=False).ids), len(t)) for k, t in texts.items()}


def test_other_tokenizers_go_to_the_library_whole(tmp_path, library):
    """A prefix space, a normalizer or another added token changes the ids: the encoder follows the file."""
    import json

    config = json.loads(library.to_str())
    prefixed, lowered, added = (json.loads(json.dumps(config)) for _ in range(3))
    prefixed["pre_tokenizer"]["add_prefix_space"] = True
    lowered["normalizer"] = {"type": "Lowercase"}
    added["added_tokens"].append({**config["added_tokens"][0], "id": 50257, "content": "[X]"})
    for name, other in (("prefixed", prefixed), ("lowered", lowered), ("added", added)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(other))
        own, encoder = Tokenizer.from_file(str(path)), bpe.Encoder(str(path))
        for t in ["Hello World", "a [X] b", " x", "", *HARD]:
            assert np.frombuffer(encoder.encode(t), "<u2").tolist() == own.encode(t, add_special_tokens=False).ids
        tree = token_counts.TokenTree.of_text("Hello WORLD and more", encoder)
        tree.edit(6, 5, "[X] Moon")
        assert tree.total == len(own.encode("Hello [X] Moon and more", add_special_tokens=False).ids)


def test_edits_touch_little(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    edits = F.expr("array(struct(5 AS at, 2 AS drop, 'new' AS insert), NULL)")
    got = {r.doc_id: r for r in token_counts.recount(odd_docs.withColumn("edits", edits)).collect()}
    assert got[4].n_reencoded < got[4].n_pretokens / 100 and got[1].n_tokens == 0 and got[1].n_tokens_edited > 0
    assert token_counts.recount(no_docs.withColumn("edits", edits)).count() == 0


def test_token_store(spark, odd_docs, odd_rows, no_docs, library, tmp_path):
    got = token_store.store_and_read(odd_docs, path=f"file://{tmp_path}/ids").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want, start = [], 0
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    for k, t, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = ids(t)
        want.append((k, start, len(own), plain.crc(struct.pack(f"<{len(own)}I", *own))))
        start += len(own)
    assert ordered(got) == ordered(want)
    assert token_store.store_and_read(no_docs, path=f"file://{tmp_path}/none").count() == 0


def test_store_of_many_shards_and_unknown_keys(spark, tmp_path):
    docs = spark.range(300).selectExpr("id * 7 AS doc_id", "concat('text ', id) AS text")
    path = f"file://{tmp_path}/many"
    manifest = token_store.write(docs, path, docs_per_shard=40)
    assert manifest.count() > 4
    asked = spark.createDataFrame([(k,) for k in [0, 7, 8, 2093, 2100, -5, 7]], "doc_id bigint")
    assert sorted(r.doc_id for r in token_store.lookup(asked, path, manifest).collect()) == [0, 7, 2093]
    again = token_store.write(docs, path, docs_per_shard=40)  # a second run leaves the same files
    assert ordered(again.collect()) == ordered(manifest.collect())


def test_a_key_of_many_records_is_many_shards(spark, tmp_path):
    least = -(1 << 63)
    rows = [(7, f"text {i}") for i in range(150)] + [(None, "same")] * 100 + [(least, "least"), (8, "eight"), (7, "text 0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = f"file://{tmp_path}/hot"
    manifest = token_store.write(docs, path, docs_per_shard=20)
    assert manifest.where("first_key = 7 AND last_key = 7").count() > 2
    got = token_store.lookup(docs, path, manifest).collect()
    keys = sorted((r.doc_id for r in got), key=str)
    assert keys == sorted((k for k, _ in rows), key=str)
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    asked = spark.createDataFrame([(least,), (9,)], "doc_id bigint")
    assert [r.doc_id for r in token_store.lookup(asked, path, manifest).collect()] == [least]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 20_000))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.number(keys).tolist()) == list(range(len(keys)))


# -- HTML --------------------------------------------------------------------------------------------------

PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>{main}<aside>side</aside><div class='comments'><p>first!</p></div><form><p>mail</p></form><script>x()</script><footer>(c)</footer></body></html>"


def extracted(spark, pages):
    table = spark.createDataFrame([(*p, "other") for p in pages], "page_id bigint, url string, html string, host string").repartition(3)
    return ordered((r.page_id, r.text) for r in html_extract.extract(table).collect())


def test_html(spark):
    pages = [
        (1, "http://h.x/a/1", PAGE.format(main="<article><h1>Head &amp; tail</h1><p>One\n <b>two</b>&nbsp;three</p><div class='ad'>buy</div></article>")),
        (2, "http://h.x/a/2", PAGE.format(main="<div>Share this page</div><div><p>Only here</p></div><div>All rights</div>")),
        (3, "http://h.x/a/3", PAGE.format(main="<div>Share this page</div><div><p>Other words</p></div><div>All rights</div>")),
        (4, None, None),
        (5, "http://h.x/a/4", ""),
        (6, "http://z/", "<p>a<p>b <!-- no --> c"),
        (6, "http://z/", "<p>a<p>b <!-- no --> c"),
    ]
    assert extracted(spark, pages) == ordered([(1, "Head & tail One two three"), (2, "Only here"), (3, "Other words"), (4, ""), (5, ""), (6, "a b c"), (6, "a b c")])
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert html_extract.extract(table.where("false")).count() == 0
    counts = {r.page_id: r.n_shared for r in html_extract.extract(table).collect()}
    assert counts[2] == counts[3] == 2 and counts[1] == 0  # the two bare lines; the rest goes by its markup


def test_differencing_deletes_places_of_the_alignment_only(spark):
    """A menu that a page repeats as a heading is kept there; equal pages and near copies of a page don't delete it."""
    body = lambda *lines: "".join(f"<div>{x}</div>" for x in lines)
    long = "a long passage that this page alone has, of many words indeed"
    pages = [
        (1, "http://h/x/1", body("Menu", "Sale", "Text " + long, "Menu", "Foot")),
        (2, "http://h/x/2", body("Menu", "Sale", "Else " + long[::-1], "Foot")),
        (2, "http://h/x/2", body("B1 " + long, "Menu", "Sale", "B2 " + long, "Foot", "B3 " + long)),  # a row of the same key and url
        (3, "http://h/y/1", body("Menu", "Sale", "Copied " + long, "Foot")),
        (4, "http://h/y/2", body("Menu", "Sale", "Copied " + long, "Foot")),
        (5, "http://h/y/3", body("Menu", "Sale", "Copied " + long, "Foot", "one more")),
        (6, "http://h/y/4", body("Menu", "Sale", "Fresh " + long.upper(), "Foot")),
    ]
    want = [(1, f"Text {long} Menu"), (2, "Else " + long[::-1]), (2, f"B1 {long} B2 {long} B3 {long}"), (3, f"Copied {long}"), (4, f"Copied {long}"), (5, f"Copied {long} one more"), (6, f"Fresh {long.upper()}")]
    assert extracted(spark, pages) == ordered(want)


def test_neighbours_by_brute_force(spark, monkeypatch):
    """Buckets of few pages find the neighbours that a look at all pages finds."""
    monkeypatch.setattr(html_extract, "BUCKET_PAGES", 4)
    rng = random.Random(6)
    pages = {(f"h{rng.randrange(3)}", f"/{rng.choice('abc')}/{rng.choice('de')}/{i}"): [i, i + 1] for i in range(60)}
    table = spark.createDataFrame([(h, p, x) for (h, p), x in pages.items()], "host string, path string, lines array<bigint>").repartition(3)
    got = {(r.host, r.path): r.near for r in html_extract._neighbours(table).collect()}
    start = lambda p, q: next((i for i, (x, y) in enumerate(zip(p.split("/"), q.split("/"), strict=False)) if x != y), min(p.count("/"), q.count("/")) + 1)
    for (h, p), near in got.items():
        own = sorted(q for g, q in pages if g == h)
        k = own.index(p)
        able = sorted((-start(p, own[j]), abs(j - k), j > k, j) for j in range(max(0, k - 2), min(len(own), k + 3)) if j != k)
        assert near == [pages[h, own[j]] for *_, j in able]


def test_reading_is_linear_and_loses_no_text():
    import time

    n = 40_000
    repeated = ("<a ", '<a x="', "<a b='", "<", "</", "<!--", "<div", "<p class=x ", "<script>", "<div>", "&", "<form><article>", "<nav></div>", "<article><form></main>")
    for page in [x * n for x in repeated] + ["<div>" * n + "</section>" * n, "<section>" * n + "</section></div>" * n, "<form>" * n + "<article>" * n + "</form>" * n]:
        began = time.perf_counter()
        html_extract.lines_of(page)
        assert time.perf_counter() - began < 5, page[:40]  # a quadratic reader takes minutes for one of them
    text = lambda page: [t for t, _ in html_extract.lines_of(page)]
    assert text("<p title=it's>Hello world</p><p>I don't know</p>") == ["Hello world", "I don't know"]
    assert text("<title>a<b></title>1 < 2 <3 & <p>x") == ["1 < 2 <3 & ", "x"] or text("<title>a<b></title>1 < 2 <3 & <p>x") == ["1 < 2 <3 &", "x"]
    kept = lambda page: [t for t, where in html_extract.lines_of(page) if where]
    assert kept("<article><div class='post-header'><h1>Head</h1></div><p>body</p><div class='ad-box'>buy</div></article>") == ["Head", "body"]
    assert kept("<form><div><article><p>in a form</article></div></form>") == ["in a form"]
    assert kept("<head><title>t</title><p>a head without end") == ["a head without end"]
    named = "<article><p>one</p><div class='notice'>n</div><div class='widget'>w</div><ul id='menu-2'><li>m</ul><div class='share-price'>two</div><section class='social history'>three</section></article>"
    assert kept(named) == ["one", "two", "three"]


def site(pages=24, seed=5):
    """A host whose pages say by no markup what is menu and what is text: (page_id, url, html) and the text of each page."""
    rng = random.Random(seed)
    menu = [prose(900 + i, 2) for i in range(6)]
    rows, want = [], {}
    for i in range(pages):
        own = [prose(1000 * i + k, rng.randrange(8, 30)) for k in range(rng.randrange(3, 9))]
        lines = menu[:3] + own[:2] + ["Read more"] + own[2:] + menu[3:]
        html = "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"
        want[i] = " ".join(own)
        if i % 3 == 0:  # an article with boxes that every page has, and a passage that articles share
            passage = prose(77, 60)
            html = f"<html><body><div>{menu[0]}</div><article><h1>{own[0]}</h1><p>{passage}</p><div>Read more</div><div class='social proof'>Tell others</div><p>{own[1]}</p></article><div>{menu[4]}</div></body></html>"
            want[i] = f"{own[0]} {passage} {own[1]}"
        rows.append((i, f"https://www.h.example/{'abc'[i % 3]}/page-{i:03d}.html", html))
    return rows, want


def test_the_registered_query_differences_pages(spark, tmp_path):
    """On pages whose markup says little, the query's text is the pages' own, which markup alone doesn't give on any of them."""
    from sluiceway.llm import queries

    rows, want = site()
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op8_extract_html(spark, str(tmp_path)).collect()}
    assert got == want
    alone = {r.page_id: r.text for r in html_extract.extract(table, differencing=False).collect()}
    assert sum(alone[i] != got[i] for i in got) == len(rows)


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = html_extract.shared_lines([*a, 99], b)
        assert html_extract.deleted([*a, 99], [-1] * len(a) + [10**6], [b]) == at
        rest = iter(b)
        assert len(at) == best[-1][-1] and at == sorted(set(at)) and all(any(a[k] == y for y in rest) for k in at)
