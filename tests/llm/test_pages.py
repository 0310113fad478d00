"""WARC archives and main text."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import random
import zlib
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc, wrapper

PAGES = "page_id long, url string, html string"


def brute_warc(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data]
        best = max(same)
        revisit = len(data) >= 1000 and i != best
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out)


def test_revisits(spark, table):
    big = "<p>é\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 1200
    rows = [(i, f"http://h/{i}?a\nb", big) for i in (5, 9, 2)] + [(1, None, "y" * 999), (3, "u", "y" * 999), (4, "u", None), (6, "u", ""), (7, "u", "z" * 1000), (8, "v", "z" * 1000), (10, "w", "only" * 400)]
    folder = table("pages", rows, PAGES)
    got = sorted(tuple(r) for r in warc.op5_warc_revisits(spark, folder).collect())
    assert got == brute_warc(rows)


def test_rows_that_repeat(spark, table):
    big = "b" * 1500
    folder = table("pages", [(3, "u", big)] * 4 + [(3, "t", big), (None, "u", big), (1, "u", big)], PAGES)
    got = [tuple(r) for r in warc.op5_warc_revisits(spark, folder).collect()]
    assert len(got) == 7 and [r[0] for r in got if r[3] == "response"] == [3]
    assert {r[4] for r in got if r[3] == "revisit"} == {3}
    empty = table("pages", [], PAGES)
    assert warc.op5_warc_revisits(spark, empty).count() == 0


def read_all(folder):
    """(headers, block) of every record, read by the standard library, and the members of each file."""
    records, members = [], []
    for f in sorted(Path(folder).rglob("part-*")):
        data = f.read_bytes()
        stream = gzip.GzipFile(fileobj=io.BytesIO(data))
        while (head := warc.headers(stream)) is not None:
            records.append((head, stream.read(int(head["content-length"]))))
        n, rest = 0, data
        while rest:
            one = zlib.decompressobj(31)
            one.decompress(rest)
            assert one.eof
            n, rest = n + 1, one.unused_data
        members.append(n)
    return records, members


def test_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/a", "x" * 1000), (2, "http://h/b", "x" * 1000)], PAGES)
    warc.write_archives(pages, str(tmp_path / "w"))
    records, members = read_all(tmp_path / "w")
    assert sorted(r["warc-type"] for r, _ in records) == ["response", "revisit"] and sum(members) == 2
    revisit = next(r for r in records if r[0]["warc-type"] == "revisit")
    response = next(r for r in records if r[0]["warc-type"] == "response")
    assert revisit[0]["warc-refers-to"] == response[0]["warc-record-id"] != revisit[0]["warc-record-id"]
    assert revisit[0]["warc-refers-to-target-uri"] == "http://h/b" and revisit[0]["warc-profile"] == warc.PROFILE
    assert response[1].endswith(b"\r\n\r\n" + b"x" * 1000) and len(revisit[1]) < 200


def test_every_record_has_an_id_of_its_own(spark, tmp_path):
    """Small rows and large ones that repeat entirely, behind a shuffle."""
    rows = [(1, "u", "small")] * 5 + [(2, "u", "b" * 1500)] * 4 + [(1, "u", "b" * 1500)] * 3 + [(None, None, None)] * 2 + [(3, "v", "alone")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"place": F.lit("own"), "digest": F.lit("own"), "n": F.lit("own")}).repartition(6)
    warc.write_archives(pages, str(tmp_path / "w"))
    records, _ = read_all(tmp_path / "w")
    ids = [r["warc-record-id"] for r, _ in records]
    assert len(ids) == len(set(ids)) == 15
    large = [r for r, _ in records if r["warc-payload-digest"].endswith(hashlib.sha1(b"b" * 1500).hexdigest())]
    response = [r for r in large if r["warc-type"] == "response"]
    assert len(large) == 7 and len(response) == 1 and response[0]["page-id"] == "2" and all(r["warc-refers-to"] == response[0]["warc-record-id"] for r in large if r is not response[0])


def test_files_are_cut_by_bytes_and_long_pages_are_read_by_pieces(spark, tmp_path, monkeypatch):
    draw = random.Random(3)
    rows = [(i, "u", draw.randbytes(3000).hex()) for i in range(40)]
    got = list(warc._packed(iter([pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows])], ["record"])])))
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    cut = list(warc._packed(iter([pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows])], ["record"])])))
    sizes = {}
    for volume, data in ((v, d) for b in cut for v, d in zip(b.column("volume").to_pylist(), b.column("value").to_pylist(), strict=True)):
        sizes[volume] = sizes.get(volume, 0) + len(data)
    assert {v for b in got for v in b.column("volume").to_pylist()} == {0} and len(sizes) > 10 and max(sizes.values()) <= 10_000
    html = "".join(draw.choice(("<p>one", "<b>two", "é")) for _ in range(1000)) * 27_000  # 100 MB
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", None)], PAGES).withColumn("html", F.when(F.col("page_id") == 1, F.repeat(F.lit(html[: len(html) // 27_000]), 27_000)).otherwise(F.col("html")))
    warc.write_archives(pages, str(tmp_path / "w"))
    data = html.encode()
    assert len(data) > 100e6
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert found == [(1, len(data), hashlib.sha1(data).hexdigest()), (2, 0, hashlib.sha1(b"").hexdigest())]
    assert max(read_all(tmp_path / "w")[1]) == -(-len(data) // warc.MEMBER_BYTES)


def test_page_ids_may_be_strings(spark, tmp_path):
    big = "b" * 1200
    warc.write_archives(spark.createDataFrame([("a\nb", "u", big), ("c", "u", big)], "page_id string, url string, html string"), str(tmp_path / "w"))
    assert sorted(tuple(r)[-2:] for r in warc.read_archives(spark, str(tmp_path / "w"), "string").collect()) == [("response", None), ("revisit", "c")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("<p", ""),
        ("plain &lt;b&gt; &amp co", "plain <b> & co"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a&nbsp;\n b<br>c <b>d</b>e</p>", "a b c de"),
        ("<nav>n</nav><header>h</header>x<aside>a</aside><footer>f</footer>", "x"),
        ("<article><h1>T</h1><p>x</p><form>f<input>g</form><div class='comments'><p>c</p></div></article><p>out", "T\nx"),
        ("<div class=\"ad top\">ad</div><div class=adult>ok</div>", "ok"),
        ("<main>m<script>var t='</p>';</script><style>p{}</style><!-- c --></main>", "m"),
        ("<ul><li>1<li>2</ul><table><tr><td>a<td>b</table>", "1\n2\na\nb"),
        ("<article><p>x</p><div id='cookie-notice'>n</div><span class='ad'>s</span>y", "x\ny"),
        ("<body class='has-sidebar'><div class='layout with-sidebar'><article>x<div class='sidebar'>s</div></article></div>", "x"),
        ("<div class='page menu-open'><p>all there is</p><nav>n</nav></div>", "all there is"),
        ("<div class='site-header'>S</div><div class='article-header'>A</div><article class='comment'>c</article>", "A"),
        ("<article><header><h1>T</h1></header>x</article><section class='comments'><article>c</article></section>", "T\nx"),
        ("<a href=\"unclosed>t", ""),
        ("<title>t</title><p>b &am", "b &am"),
    ],
)
def test_extract(html, want):
    assert wrapper.extract(html, None) == want


def test_constant_slots_go(spark, table):
    page = lambda i: f"<html><body><div><p>Sign up for news</p><p>Body {i} of {i * 7}</p><p>{'shared passage' if i % 3 == 0 else f'more {i}'}</p></div><div>All rights</div></body></html>"
    rows = [(i, f"http://Site.org/{i}", page(i)) for i in range(20)] + [(50, "http://few.org/1", page(1)), (51, None, page(2)), (52, "http://site.org/", None)]
    folder = table("pages", rows, PAGES)
    got = {r.page_id: r for r in wrapper.op9_main_text(spark, folder).collect()}
    assert len(got) == 23
    for i in range(20):
        assert got[i].text == f"Body {i} of {i * 7}\n" + ("shared passage" if i % 3 == 0 else f"more {i}")
        assert got[i].n_chars == len(got[i].text)
    assert got[50].text.startswith("Sign up for news\nBody 1") and got[51].text.endswith("All rights") and got[52].text == ""


def test_templates_joined_by_host_give_the_same(spark, table, monkeypatch):
    rows = [(i, f"http://site.org/{i}", f"<p>Always here</p><p>text {i}</p>") for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES)
    broadcast = sorted(tuple(r) for r in wrapper.main_text(pages).collect())
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 1)
    assert sorted(tuple(r) for r in wrapper.main_text(pages).collect()) == broadcast and broadcast[0][2] == "text 0"
    assert wrapper.main_text(pages.limit(0)).count() == 0


def test_tree_matching():
    sign, kids = (lambda x: x[0]), (lambda x: x[1])
    leaf = lambda s: (s, [])
    a = [("d", [leaf("x"), leaf("y")]), leaf("p"), ("d", [leaf("z")])]
    b = [leaf("q"), ("d", [leaf("z")]), leaf("p"), ("d", [leaf("y")])]
    size, pairs = wrapper.align(a, b, sign, sign, kids, kids)
    assert size == 2 + 1 or size == 3
    assert pairs == sorted(pairs) and all(a[i][0] == b[j][0] for i, j in pairs)


def test_copies_count_once_for_a_template(spark):
    rows = [(100 * i + c, f"http://site.org/{i}/{c}", f"<p>Always here</p><p>text {i}</p>") for i in range(60) for c in range(25)]
    got = wrapper.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 1500 and all(r.text == f"text {r.page_id // 100}" for r in got)


def test_constant_texts_are_counted_over_all_pages(spark):
    """On each of 12 hosts a text on 80% of 200 pages is constant and one on 60% is not, whatever 16 pages say."""
    page = lambda i: ("<div class=a>Four fifths</div>" if i % 5 else "") + ("<div class=b>Three fifths</div>" if i % 5 > 1 else "") + f"<p>Body {i}</p>"
    rows = [(1000 * h + i, f"http://site{h}.org/{i}", page(i) + f"<p>of {h}-{i}</p>") for h in range(12) for i in range(200)]
    for r in wrapper.main_text(spark.createDataFrame(rows, PAGES)).collect():
        h, i = divmod(r.page_id, 1000)
        assert r.text == ("Three fifths\n" if i % 5 > 1 else "") + f"Body {i}\nof {h}-{i}"


def brute_align(a, b):
    """Simple tree matching cell by cell; ties go to the end."""
    weight = [[1 + brute_align(x[1], y[1])[0] if x[0] == y[0] else 0 for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j] + weight[i][j] if weight[i][j] else 0, best[i][j + 1], best[i + 1][j])
    i, j, pairs = len(a), len(b), []
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


@pytest.mark.parametrize(("m", "n"), [(3, 4), (25, 40), (60, 9), (7, 300), (201, 203), (230, 190)])
def test_long_lists_are_aligned_like_short_ones(m, n):
    draw = random.Random(m * n)
    tree = lambda d: (draw.choice("ppd"), [tree(d - 1) for _ in range(draw.choice((0, 1, 1, 3)))] if d else [])
    a, b = [tree(2) for _ in range(m)], [tree(2) for _ in range(n)]
    assert wrapper.align(a, b, lambda x: x[0], lambda x: x[0], lambda x: x[1], lambda x: x[1]) == brute_align(a, b)


def test_one_long_page_does_not_hide_a_trailing_constant(spark):
    page = lambda i: "".join(f"<p>Body {i} {k}</p>" for k in range(5000 if i == 3 else 9 + i % 7)) + "<p>Sign up today</p>"
    got = wrapper.main_text(spark.createDataFrame([(i, f"http://site.org/{i}", page(i)) for i in range(16)], PAGES)).collect()
    assert all(r.text == "\n".join(f"Body {r.page_id} {k}" for k in range(5000 if r.page_id == 3 else 9 + r.page_id % 7)) for r in got)


def sites(seed, named):
    """(page_id, url, html, article) of six layouts. named: with the elements and classes that say what a part is; else all of it in plain divisions."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(800)]
    some = lambda a, b: " ".join(draw.choice(vocabulary) for _ in range(draw.randint(a, b)))
    tag = lambda name, inner, cls="": f'<{name}{f" class={cls}" if cls else ""}>{inner}</{name}>' if named else f"<div>{inner}</div>"
    out = []
    for site in range(6):
        for i in range(24):
            title, blocks = some(3, 8), [some(8, 60) for _ in range(draw.randint(1, 9))]
            menu = "".join(f'<li><a href="/{draw.choice(vocabulary)}">{draw.choice(vocabulary)}</a></li>' for _ in range(6 + i % 3))
            tail = f"All rights reserved by site {site}"
            top = tag("nav", f"<ul>{menu}</ul>")
            notice = tag("div", f"This site {site} uses small files to know you again.", "cookie-notice")
            paragraphs = "".join(f"<p>{b}</p>" for b in blocks)
            if site % 3 == 2:
                paragraphs = f"<div>{paragraphs}</div>"
            body = tag("article", f"<h1>{title}</h1>{paragraphs}")
            side = tag("aside", f"<h3>More</h3><ul>{menu}</ul>") if site % 2 else ""
            advert = tag("div", f"<a href=/x>{some(2, 6)}</a>", "ad")
            foot = tag("footer", f"<p>{tail}</p><p>{some(1, 3)}</p>")
            wrap = "<div><div>" if site % 3 == 1 else ""
            html = f"<html><head><title>{title}</title></head><body>{top}{notice}{wrap}{advert}{body}{side}{'</div></div>' if wrap else ''}{foot}</body></html>"
            out.append((1000 * site + i, f"http://site{site}.org/{i}", html, "\n".join([title, *blocks])))
    return out


def score(got, pages):
    """Word precision and recall of texts by page."""
    both = found = want = 0
    for i, _, _, article in pages:
        a, b = Counter(got[i].split()), Counter(article.split())
        both, found, want = both + sum((a & b).values()), found + sum(a.values()), want + sum(b.values())
    return both / found, both / want


@pytest.mark.parametrize(("named", "least"), [(True, (1.0, 1.0)), (False, (0.99, 1.0))])
def test_articles_of_sites_with_and_without_names(spark, named, least):
    pages = sites(7, named)
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame([p[:3] for p in pages], PAGES)).collect()}
    precision, recall = score(got, pages)
    alone = score({i: wrapper.extract(html, None) for i, _, html, _ in pages}, pages)
    print(f"named {named}: precision {precision:.4f}, recall {recall:.4f}; without templates {alone[0]:.4f}, {alone[1]:.4f}")
    assert precision >= least[0] and recall >= least[1]
    assert named or alone[0] < 0.9


def brute_main_text(pages):
    """One host's texts, by brute_align on whole trees and plain loops. pages: distinct htmls, no more than SAMPLE, in the order of their draws."""
    tree = lambda n: (n.sign, [tree(c) for c in n.children])
    shape = lambda s: (s["sign"], [shape(c) for c in s["kids"]])
    new = lambda node: {"sign": node.sign, "kids": [], "n": 0, "aside": [0, 0, 0], "met": Counter()}

    def pairs(slot, node):
        return brute_align([shape(c) for c in slot["kids"]], [tree(c) for c in node.children])[1]

    def fold(slot, node):
        slot["n"] += 1
        slot["aside"][node.aside] += 1
        if node.text:
            slot["met"][node.text] += 1
        found, kids, i = {j: i for i, j in pairs(slot, node)}, [], 0
        for j, kid in enumerate(node.children):
            if j in found:
                kids += slot["kids"][i : found[j]]
                i = found[j] + 1
                here = slot["kids"][found[j]]
            else:
                here = new(kid)
            fold(here, kid)
            kids.append(here)
        slot["kids"] = kids + slot["kids"][i:]

    root = new(wrapper.Node("#root"))
    for html in pages:
        fold(root, wrapper.parse(html))

    def packed(slot):
        aside = next((k for k in (2, 1) if 2 * sum(slot["aside"][k:]) >= slot["n"]), 0)
        return [slot["sign"], sorted([wrapper._key(t), len(t)] for t, n in slot["met"].items() if n > 1), aside, 0, [packed(c) for c in slot["kids"]]]

    made = json.dumps(packed(root))
    t = wrapper.Template(made)
    numbers = {id(s): s.number for s in t.slots}
    sums, hits = {}, Counter()

    def measure(slot, copy, node):
        k = numbers[id(copy)]
        n, chars, links = sums.get(k, (0, 0, 0))
        sums[k] = n + 1, chars + len(node.text), links + node.links
        if node.text and wrapper._key(node.text) in copy.texts:
            hits[wrapper._hit(k, wrapper._key(node.text))] += 1
        for i, j in pairs(slot, node):
            measure(slot["kids"][i], copy.children[i], node.children[j])

    for html in pages:
        measure(root, t.root, wrapper.parse(html))
    judged = wrapper.Template(wrapper.judge(made, len(pages), sums, hits))
    return {html: wrapper.extract(html, judged) for html in pages}


@pytest.mark.parametrize("named", [True, False])
def test_main_text_against_brute_force(spark, named):
    pages = [p for p in sites(11, named) if p[0] % 1000 < 14]
    df = spark.createDataFrame([p[:3] for p in pages] + [(9000 + i, *p[1:3]) for i, p in enumerate(pages[:9])], PAGES)
    draws = {r.page_id: r.d for r in df.select("page_id", F.xxhash64("html").alias("d")).collect()}
    want = {}
    for site in range(6):
        own = sorted((p for p in pages if p[0] // 1000 == site), key=lambda p: draws[p[0]])
        want |= brute_main_text([p[2] for p in own])
    html = {r.page_id: r.html for r in df.collect()}
    got = wrapper.main_text(df).collect()
    assert len(got) == len(pages) + 9 and all(r.text == want[html[r.page_id]] for r in got)


def test_deep_and_long_pages(spark):
    """Elements nested deeper than NESTING are read as siblings; constant text is known at any depth and in lists of any length."""
    deep = lambda i: "<div>" * 700 + f"<p>Body {i} of {i * 7}</p><p>Sign up today</p><p>and {i}</p>"
    rows = [(i, f"http://deep.org/{i}", deep(i)) for i in range(10)]
    rows += [(100 + i, f"http://long.org/{i}", "".join(f"<p>Row {i} {k}</p>" for k in range(700 + i)) + "<p>Sign up today</p>") for i in range(9)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("own"), "template": F.lit("own"), "draw": F.lit("own")})).collect()}
    assert all(got[i] == f"Body {i} of {i * 7}\nand {i}" for i in range(10))
    assert all(got[100 + i].split("\n") == [f"Row {i} {k}" for k in range(700 + i)] for i in range(9))


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<p>a</p><section class='related-work'><h2>Related work</h2><p>b</p></section>", "a\nRelated work\nb"),
        ("<p>By <span class='social'>me</span> and <b class='search-hit'>you</b></p>", "By me and you"),
        ("<p>a</p><div id='share-price'>b</div><p class='cookie-recipe notice-of-motion'>c</p>", "a\nb\nc"),
        ("<table class='menu-of-the-day'><tr><td>soup</td></tr></table>", "soup"),
        # names as a whole still speak
        ("<p>a</p><div class='related'>b</div><div class='share-buttons'>c</div><div class='related posts-list'>d</div><ul id='related-posts'><li>e</ul>", "a"),
        ("<p>a <span class='ad'>b</span><a class='sponsored'>c</a> <span hidden>d</span><i style='display: none'>e</i>f</p>", "a f"),
    ],
)
def test_words_of_an_article_do_not_go_by_parts_of_names(inner, text):
    """Within an article, and with or without an article element around it."""
    assert wrapper.extract(f"<body><nav>n</nav><article>{inner}</article></body>", None) == text
    assert wrapper.extract(f"<body><nav>n</nav><div class='post-content wide'>{inner}</div></body>", None) == text


def test_template_keeps_sections_with_telling_names(spark, table):
    """The same on a host with a template, where slots are judged."""
    page = lambda i: f"<body><nav><a href=1>n</a></nav><article><p>Body {i} of words that vary</p><section class='related-work'><p>Work {i}</p></section><p>By <span class='social'>me{i}</span></p><div class='share-buttons'>Share {i}</div></article></body>"
    rows = [(i, f"https://one.example/{i}", page(i)) for i in range(12)]
    folder = table("pages", rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.op9_main_text(spark, folder).collect()}
    assert got == {i: f"Body {i} of words that vary\nWork {i}\nBy me{i}" for i in range(12)}


def test_archives_of_tables_with_clashing_columns(spark, table):
    """Extra columns, named as the results and the operator's own are, change nothing."""
    rows = [(1, "http://h/1", "x" * 1200), (2, "http://h/2", "x" * 1200), (3, "http://h/3", None)]
    plain = sorted(map(tuple, warc.op5_warc_revisits(spark, table("pages", rows, PAGES)).collect()))
    folder = table("pages", [(*r, "a", 7, "b", 9, "c") for r in rows], PAGES + ", payload_digest string, payload_bytes int, record_type string, refers_to long, record string")
    assert sorted(map(tuple, warc.op5_warc_revisits(spark, folder).collect())) == plain == brute_warc(rows)
