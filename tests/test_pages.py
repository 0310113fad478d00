from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import urls as U


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://H.EDU/A/b//?q=1#f", "https://h.edu/A/b?q=1"),
        ("http://h", "http://h"),
        ("http://h/", "http://h/"),
        ("http://H:80/a/;x=1?", "http://h:80/a"),
        ("http://h/a;b/c;d", "http://h/a;b/c"),
        ("/p/q/", "/p/q"),
        ("", ""),
    ],
)
def test_normalise(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.normalise(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www2.site.org/x", True), ("https://site.org", True), ("https://a.site.org/", False), ("https://site.org/x.PDF", False), ("https://site.org/blogin", False), ("https://site.org/.pdf", True), ("https://site.org/a b", False), ("ftp://site.org/", False)],
)
def test_admitted(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.admitted(F.col("u"), "site.org")).first()[0] is want


def test_links():
    page = '<nav><a href="/a#x">1</a></nav><a>none</a><a href="">e</a><a href="b?c=1">2</a><a href="b?c=1">2</a>'
    assert U.anchors(page, "http://h/d/e") == ["http://h/a", "http://h/d/b?c=1", "http://h/d/b?c=1"]
    assert U.anchors(None, None) == []


LONG = "a line that is long enough"


def test_titles():
    assert H.document("<title>A | B | C</title><h1>D</h1>")["title"] == "A"
    assert H.document("<title> | B</title><h1>D</h1>")["title"] == "D"
    assert H.document("<header><h1>D</h1></header>")["title"] == ""


def test_nested_elements_repeat():
    got = H.document(f"<ul><li><p>{LONG}</p></li></ul>")
    assert got["sections"] == [{"heading": "", "text": f"{LONG}\n{LONG}"}]
    assert H.document(f"<p>{LONG}<p>other {LONG}")["sections"][0]["text"].count("other") == 2


def test_sections_rows_and_lengths():
    page = f"<h2>One</h2><p>{'x' * 15}</p><p>{'y' * 16}</p><table><tr><td>12345</td><th>67</th></tr><tr><td>12345</td><td>678</td></tr></table><h3>Two</h3><p>{'z' * 20}</p><h4>Three</h4><p>{'w' * 21}</p><nav><p>{LONG}</p></nav><!-- <p>{LONG}</p> -->"
    got = H.document(page)
    assert [s["heading"] for s in got["sections"]] == ["One", "Three"]
    assert got["sections"][0]["text"] == f"{'y' * 16}\n12345 | 678"
    assert got["text"].startswith("## One\n") and "\n## Three\n" in got["text"]


def test_quick_and_question_text():
    page = f"<h1>{'h' * 15}</h1><h2>{'h' * 16}</h2><table><tr><td>cell one</td><td>cell two</td></tr></table><div><p>{LONG}</p></div>"
    assert H.quick_text(page) == f"## {'h' * 16}\n{LONG}\ncell one | cell two"
    assert H.question_text(page).split("\n") == ["cell one | cell two", "h" * 16, LONG, LONG]
    assert H.quick_text(None) == "" and H.question_text("") == ""


def test_pages_of_a_batch_are_parsed_by_slices():
    """A batch has up to 64 MiB of pages, whose texts may be many times as large: no more than a slice of them is held."""
    import pyarrow as pa

    from corpusloom.functions import html as H

    pages = pa.array([f"<title>t{i}</title><p>some words of page {i}" for i in range(100)] + [None])
    for udf, of in ((H.parsed, H.document), (H.titled, H.title), (H.sectioned, H.sections), (H.quick, H.quick_text), (H.for_questions, H.question_text)):
        parts = list(udf.func(iter([pages, pages.slice(0, 3)])))
        assert max(map(len, parts)) <= H.SLICE
        assert [x for p in parts for x in p.to_pylist()] == [of(h) for h in [*pages.to_pylist(), *pages.to_pylist()[:3]]]
