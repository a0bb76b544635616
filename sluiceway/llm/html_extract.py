"""HTML extraction by nearest-URL page differencing.

Each page becomes lines, the text of one block each. All its lines, those of articles too, are aligned by longest common subsequence with those
of the page that is nearest by URL path on the same host (of pages with an article for those that have one, and of the others for those that have none): what both have in the same order is what the site puts on every page, and is deleted.

Markup helps where pages say too little or too much. A line under markup that surely is a menu, header, footer, sidebar, notice, advert, form or
comment goes whether or not the neighbour has it (MARKED), since such lines differ from page to page, too. A paragraph, heading, list item or
table cell of an article stays even if the neighbour has it (TEXT): articles repeat passages. Of all other lines (OPEN), on pages without an article,
beside it, in its bare boxes, or under names of which only some are those of boilerplate, differencing decides.

A neighbour that shares most of a page's text outside the marked places (SAME of its characters) is a copy of it and says
nothing; the next nearest is taken then, NEIGHBOURS on either side at most, and where all are copies nothing is deleted by differencing.
Pages of a host with the very same lines are one page to the search, so no number of copies hides the neighbours.

What is exchanged between pages are hashes and sizes of lines, not texts. Neighbours come from a global order by host
and path: ranges of about RANGE_BYTES are numbered, and buckets of places overlap by NEIGHBOURS, so a host that holds a third of all pages
is many buckets.

Null html is empty text. Null urls are a host of their own. Rows of one url and html have one result each, the same. An
empty table gives an empty result. Other columns are ignored. Broken markup is read as browsers read it: a quote counts in a
tag only, behind an equals sign, and what never ends runs to the end of the page. Reading is linear in the page, whatever it closes or leaves open.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import batch_rows, cut, slices

NEIGHBOURS = 2
SAME = 0.8
BUCKET_PAGES = 500
RANGE_BYTES = 64 << 20

#: A tag whose attributes have no surprises; possessive, so that it never looks at a character twice.
PLAIN = re.compile(r"""<(/?)([A-Za-z][^\s/><]*+)((?>\s++(?:[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>=`]++))?+)?+)*+)\s*+/?+>""")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]?[^\s/>=]*+)\s*+(=\s*+(?:"([^"]*+)("?)|'([^']*+)('?)|([^\s>]*+)))?""")
SIGNS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}

# Elements that are never text of an article, those that hold one, and those that may hold others.
CHROME = {"head", "nav", "footer", "aside", "form", "menu", "button", "dialog", "noscript", "template", "svg", "select", "object", "canvas", "audio", "video"}
ARTICLE = {"article", "main"}
HOLDERS = CHROME | ARTICLE | {"html", "body", "header", "div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "td", "th", "blockquote", "figure", "details"}
#: These end a block; other elements are inline.
BLOCKS = HOLDERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "br", "title", "caption", "figcaption", "address", "summary", "option", "thead", "tfoot", "fieldset", "legend", "center"}
IN_HEAD = {"head", "base", "link", "meta", "title", "style", "script", "noscript", "template"}
#: Elements whose text is an article's own.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "td", "th", "caption", "figcaption"}
# Words in class, id or role that name boilerplate, those of them that may name a part of an article, and words that say nothing.
BOILERPLATE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent popup modal newsletter subscribe sidebar breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies related share sharing social navigation complementary notice notices alert signup login nav navbar menu footer reply widget search contentinfo banner side header masthead skip".split())
ARTICLE_PARTS = set("banner side header masthead skip".split())
NEUTRAL = set("box block bar area section container wrapper wrap list links link buttons button btn icons icon top bottom left right inner outer item items module panel group row col content text title page site main post entry article story primary secondary global".split())

TEXT, OPEN, MARKED = 2, 1, 0


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """The tags of a page in order: (start, end, name in lower case, whether it closes, attributes as written). Comments and
    the contents of scripts and the like are tags of the name "" that cover them."""
    at, size = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        if m := PLAIN.match(page, start):
            end, name, closes, attributes = m.end(), m[2].lower(), m[1] == "/", m[3]
        elif page.startswith("<!--", start):
            stop = page.find("-->", start + 2)
            at = size if stop < 0 else stop + 3
            yield start, at, "", False, ""
            continue
        elif m := NAME.match(page, start):
            end = m.end()
            while end < size and page[end] != ">":
                a = ATTRIBUTE.match(page, end)
                open_quote = a[3] is not None and not a[4] or a[5] is not None and not a[6]
                end = size if open_quote else a.end() if a.end() > end else end + 1
            name, closes, attributes = m[1].lower(), page[start + 1] == "/", page[m.end() : end]
            end = min(size, end + 1)
        elif page[start + 1 : start + 2] in ("!", "?", "/"):
            stop = page.find(">", start)
            at = size if stop < 0 else stop + 1
            yield start, at, "", False, ""
            continue
        else:
            at = start + 1  # a lone < is text
            continue
        yield start, end, name, closes, attributes
        at = end
        if name in RAW and not closes:
            m = RAW[name].search(page, end)
            at = m.start() if m else size
            yield end, at, "", False, ""


def named(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether class, id or role name boilerplate and nothing else, and whether they do so among other names."""
    some = other = False
    for m in SIGNS.finditer(attributes):
        for word in re.split(r"[-_\s]+", (m[1] or m[2] or m[3] or "").lower()):
            if word in BOILERPLATE and not (inside and word in ARTICLE_PARTS):
                some = True
            elif word and word not in NEUTRAL and word not in BOILERPLATE and not word.isdigit():
                other = True
    return some and not other, some and other


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The visible lines of a page: (text, TEXT of an article, MARKED as boilerplate or OPEN)."""
    page = page or ""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    holders: list[list] = []  # open holders: [name, whether it is boilerplate, whether it is an article, whether it may be boilerplate]
    counts: dict[str, int] = {}  # how many are open by name
    chromes: list[list] = []  # those that are boilerplate
    hidden = article = doubtful = others = 0  # others: those of chromes that aren't forms
    textual = False

    def end() -> None:
        line = " ".join(html_lib.unescape("".join(words)).split())
        words.clear()
        if line:
            out.append((line, MARKED if hidden else TEXT if article and textual and not doubtful else OPEN))

    def close(name: str) -> None:
        nonlocal hidden, article, doubtful, others
        if not counts.get(name):
            return
        while True:
            holder = holders.pop()
            counts[holder[0]] -= 1
            if holder[1]:
                chromes.pop()
                hidden -= 1
                others -= holder[0] != "form"
            article -= holder[2]
            doubtful -= holder[3]
            if holder[0] == name:
                return

    at = 0
    for start, stop, name, closes, attributes in tags(page):
        if start > at:
            words.append(page[at:start])
        at = stop
        if name not in BLOCKS:
            if not name:
                words.append("")
            continue
        end()
        if name in TEXTUAL:
            textual = not closes
        elif name in HOLDERS:
            textual = False
        if holders and holders[-1][0] == "head" and name not in IN_HEAD:  # a head that was never closed ends here
            close("head")
        if name not in HOLDERS:
            continue
        if closes:
            close(name)
            continue
        holds = name in ARTICLE
        if holds and chromes and not others:  # a form around the whole page hides no article
            for x in chromes:
                x[1] = False
            chromes.clear()
            hidden = 0
        chrome, doubt = name in CHROME or name == "header" and not article, False
        if not chrome and name not in ("html", "body"):
            chrome, doubt = named(attributes, article > 0 or holds)
        holder = [name, chrome, holds and not chrome, doubt]
        holders.append(holder)
        counts[name] = counts.get(name, 0) + 1
        if chrome:
            chromes.append(holder)
            others += name != "form"
        hidden += chrome
        article += holder[2]
        doubtful += doubt
    words.append(page[at:])
    end()
    return [x for x in out if x[0]]


def _ahead(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` with b[:0], b[:1] and so on: a row of bits for each element of ``a``."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a bit that is 0 is a place where the length grows
    for x in a:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
    lengths, n = [0], 0
    for bit in format(row, f"0{len(b)}b")[::-1] if b else "":
        n += bit == "0"
        lengths.append(n)
    return lengths


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: halving ``a`` and finding where ``b`` parts (Hirschberg),
    so memory is linear, and repeated lines cost no more than others."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        mid = (a0 + a1) // 2
        left, right = _ahead(a[a0:mid], b[b0:b1]), _ahead(a[mid:a1][::-1], b[b0:b1][::-1])
        n = b1 - b0
        cut_at = max(range(n + 1), key=lambda j: left[j] + right[n - j])
        todo += [(a0, mid, b0, b0 + cut_at), (mid, a1, b0 + cut_at, b1)]
    return sorted(out)


def deleted(lines: list[int], sizes: list[int], neighbours: list[list[int]]) -> list[int]:
    """Places of the open lines that the nearest neighbour which is no copy has too. ``sizes``: characters of lines, 0 for marked ones, below 0 for open ones."""
    own = sum(map(abs, sizes))
    for other in neighbours:
        places = shared_lines(lines, other)
        same = sum(abs(sizes[k]) for k in places)
        if not own or same < SAME * own:
            return [k for k in places if sizes[k] < 0]
    return []


def _neighbours(pages: DataFrame) -> DataFrame:
    """Distinct pages (host, path, lines) with ``near``: the lines of up to NEIGHBOURS pages of the host on either side in
    order of path, those with the longest common start of the path first, then the nearer ones."""
    order = ["host", "path", "lines"]
    count, held = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lines").cast("long") * 8 + 100), F.lit(0))).first()
    least = min(-(-count // BUCKET_PAGES), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few pages are several tasks, too
    ranged = cut(pages.repartitionByRange(max(1, least, -(-held // RANGE_BYTES)), *order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = ranged.join(starts, "range").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1)
    # a page also stands in the buckets of its neighbours
    home = F.floor(F.col("place") / BUCKET_PAGES)
    buckets = F.array_distinct(F.array(*[F.floor((F.col("place") + d) / BUCKET_PAGES) for d in (-NEIGHBOURS, 0, NEIGHBOURS)]))
    dealt = placed.withColumn("home", home).withColumn("bucket", F.explode(buckets))
    w = Window.partitionBy("bucket").orderBy("place")
    page = F.struct("host", "path", "lines")
    found = dealt.select("*", *[f(page, d).over(w).alias(f"{n}{d}") for d in range(1, NEIGHBOURS + 1) for n, f in (("b", F.lag), ("a", F.lead))]).where("bucket = home")
    parts = lambda c: F.split(F.coalesce(c, F.lit("")), "/")

    def start_of(other: Column) -> Column:
        """How many segments the two paths share from their start on."""
        same = F.zip_with(parts(F.col("path")), parts(other["path"]), lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same))

    near = [F.when(F.col(c)["host"] == F.col("host"), F.struct((-start_of(F.col(c))).alias("s"), F.lit(d).alias("d"), F.lit(k).alias("k"), F.col(c)["lines"].alias("lines"))) for d in range(1, NEIGHBOURS + 1) for k, c in enumerate((f"b{d}", f"a{d}"))]
    return found.select("host", "path", "lines", F.transform(F.array_sort(F.array_compact(F.array(*near))), lambda x: x["lines"]).alias("near"))


def _url_parts() -> tuple[Column, Column]:
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^www\.|:[0-9]+$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"/+$", "")
    return host, path


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", differencing: bool = True) -> DataFrame:
    """Per page: key, url, text (main text, blocks joined by one space; empty if none), n_lines (blocks of the page) and
    n_shared (those that differencing deleted, which markup alone would keep). Without ``differencing`` markup decides alone, which is for comparison."""
    spark = pages.sparkSession
    key_type = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            lines, sizes, articles = [], [], []
            for x in b.column(2):
                found = lines_of(x.as_py())
                lines.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in found])
                sizes.append([0 if where == MARKED else len(t) if where == TEXT else -len(t) for t, where in found])
                articles.append(any(where == TEXT for _, where in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(articles, pa.bool_())], ["digest", "url", "lines", "sizes", "article"])

    host, path = _url_parts()
    # a page is known by its url and html: rows that share both have the same text
    digest = F.md5(F.coalesce("html", F.lit("")))
    with batch_rows(spark):
        narrow = cut(rows.where(F.lit(differencing)).select(digest.alias("digest"), "url", "html").mapInArrow(hashed, "digest string, url string, lines array<bigint>, sizes array<int>, article boolean").where("size(lines) > 0").withColumns({"path": path, "host": F.concat_ws(" ", host, F.col("article").cast("string"))}))
    # of the pages of a host with the same lines the first by path stands for all
    known = narrow.groupBy("host", "lines").agg(F.min("path").alias("path"))
    near = _neighbours(known).select("host", "lines", "near")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [deleted(*x) for x in zip(*[b.column(k).to_pylist() for k in range(2, 5)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32()))], ["digest", "url", "gone"])

    once = narrow.dropDuplicates(["url", "digest"])
    with batch_rows(spark, 1000):
        gone = cut(once.join(near, ["host", "lines"]).select("digest", "url", "lines", "sizes", "near").mapInArrow(compared, "digest string, url string, gone array<int>").where("size(gone) > 0"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, all_, shared = [], [], []
            for x, places in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                found, drop = lines_of(x.as_py()), set(places or ())
                out.append(" ".join(t for k, (t, where) in enumerate(found) if where != MARKED and k not in drop))
                all_.append(len(found))
                shared.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(all_, pa.int64()), pa.array(shared, pa.int64())], ["key", "url", "text", "n_lines", "n_shared"])

    named = gone.select(F.col("digest").alias("__digest"), F.col("url").alias("__url"), "gone")
    joined = rows.withColumn("digest", digest).join(named, (F.col("digest") == F.col("__digest")) & F.col("url").eqNullSafe(F.col("__url")), "left")
    found = joined.select("key", "url", "html", "gone").mapInArrow(texts, f"key {key_type}, url string, text string, n_lines bigint, n_shared bigint")
    return found.withColumnsRenamed({"key": key, "url": url})
