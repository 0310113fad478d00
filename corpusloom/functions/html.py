"""HTML to text. One Arrow UDF for each form of text, slice by slice; a small tree builder over the standard library's tokenizer.

An end tag closes the nearest open element of its name and all within it, or nothing; void elements close at once; there are no
implied end tags, so unclosed paragraphs nest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructType

#: Elements without an end tag, headings, and elements that are no text of the page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILERPLATE = {"nav", "footer", "header", "script", "style", "noscript", "aside", "iframe", "svg", "form"}
BOILERPLATE_LOOSE = {"nav", "footer", "header", "script", "style", "noscript", "aside"}
LINE_TAGS = {"p", "li", "dd", "dt", "blockquote", "pre"}
LOOSE_TAGS = HEADINGS | {"p", "li", "dd", "dt", "span", "div"}
#: Least lengths, all exclusive: of a table row, a line and a section.
ROW, LINE, SECTION = 10, 15, 20


class Element:
    __slots__ = ("tag", "parts")

    def __init__(self, tag: str):
        self.tag, self.parts = tag, []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [p for p in reversed(self.parts) if not isinstance(p, str)]
        while stack:
            e = stack.pop()
            yield e
            stack += [p for p in reversed(e.parts) if not isinstance(p, str)]

    def text(self, joint: str = " ") -> str:
        """Stripped, non-empty texts below."""
        out, stack = [], list(reversed(self.parts))
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                if p.strip():
                    out.append(p.strip())
            else:
                stack += reversed(p.parts)
        return joint.join(out)


class _Builder(HTMLParser):
    def __init__(self, dropped: set[str]):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]
        self.dropped = dropped

    def handle_starttag(self, tag, attrs):
        e = Element(tag)
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Element(tag))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(html: str | None, dropped: set[str]) -> Element:
    """The page without comments and without the dropped elements."""
    b = _Builder(dropped)
    b.feed(html or "")
    b.close()
    stack = [b.root]
    while stack:
        e = stack.pop()
        e.parts = [p for p in e.parts if isinstance(p, str) or p.tag not in dropped]
        stack += [p for p in e.parts if not isinstance(p, str)]
    return b.root


def row_text(row: Element) -> str:
    cells = [e.text() for e in row.walk() if e.tag in ("td", "th")]
    return " | ".join(c for c in cells if c)


def title_of(page: Element) -> str:
    """The title up to its first bar, else the first h1."""
    for tag in ("title", "h1"):
        found = next((e for e in page.walk() if e.tag == tag), None)
        text = found.text("") if found else ""
        if tag == "title":
            text = re.sub(r"\s*\|.*$", "", text).strip()
        if text:
            return text
    return ""


def compatible(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def pieces_of(page: Element) -> Iterator[tuple[int, str]]:
    """(number of headings so far, text) of every heading and every line or row that is long enough, in document order. Elements within elements give their text again."""
    n = 0
    for e in page.walk():
        n += e.tag in HEADINGS
        if e.tag in HEADINGS:
            yield n, e.text()
        elif e.tag == "tr" and len(row := row_text(e)) > ROW:
            yield n, row
        elif e.tag in LINE_TAGS and len(line := compatible(e.text())) > LINE:
            yield n, line


def sections_of(page: Element) -> list[dict[str, str]]:
    """Pieces with one number are one section: the first is its heading, but for those before any heading."""
    out = []
    for n, group in groupby(pieces_of(page), key=itemgetter(0)):
        heading, *lines = ([] if n else [""]) + [text for _, text in group]
        out.append({"heading": heading, "text": "\n".join(lines).strip()})
    return [s for s in out if len(s["text"]) > SECTION]


def document(html: str | None) -> dict:
    """title, text and sections of a page."""
    page = tree(html, BOILERPLATE)
    sections = sections_of(page)
    text = "".join((f"\n## {s['heading']}\n" if s["heading"] else "") + s["text"] + "\n" for s in sections)
    return {"title": title_of(page), "text": text.strip(), "sections": sections}


def quick_text(html: str | None) -> str:
    """Lines of a page, then the rows of its tables; short headings are left out."""
    page = tree(html, BOILERPLATE)
    lines = []
    for e in page.walk():
        if e.tag in HEADINGS or e.tag in LINE_TAGS:
            text = e.text()
            if len(text) > LINE:
                lines.append(f"\n## {text}" if e.tag in HEADINGS else text)
    for table in (e for e in page.walk() if e.tag == "table"):
        lines += [t for t in (row_text(r) for r in table.walk() if r.tag == "tr") if len(t) > ROW]
    return "\n".join(lines).strip()


def question_text(html: str | None) -> str:
    """Rows of the tables, then all other lines, spans and divisions included, of the page without its tables."""
    page = tree(html, BOILERPLATE_LOOSE)
    lines: list[str] = []
    stack = [page]
    while stack:  # outermost tables; those within are read with them
        e = stack.pop()
        for t in (p for p in e.parts if not isinstance(p, str) and p.tag == "table"):
            lines += [x for x in (row_text(r) for r in t.walk() if r.tag == "tr") if len(x) > ROW]
        e.parts = [p for p in e.parts if isinstance(p, str) or p.tag != "table"]
        stack += [p for p in reversed(e.parts) if not isinstance(p, str)]
    lines += [t for t in (e.text() for e in page.walk() if e.tag in LOOSE_TAGS) if len(t) > LINE]
    return "\n".join(lines)


#: Types are objects: type strings can only be parsed where a session runs.
_SECTION = StructType().add("heading", StringType()).add("text", StringType())
_SECTIONS = ArrayType(_SECTION)
#: Pages of a batch that are Python objects at one time, with what is made of them.
SLICE = 16


def _by_slices(of, kind):
    """A column function that applies `of` to each page. Pages stay in Arrow's memory but for a slice, and each slice's results leave before the next is read: a batch of nested pages may give many times its size."""
    into = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for at in range(0, len(pages), SLICE):
                yield pa.array([of(h) for h in pages.slice(at, SLICE).to_pylist()], into)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)


def title(html: str | None) -> str:
    return title_of(tree(html, BOILERPLATE))


def sections(html: str | None) -> list[dict[str, str]]:
    return sections_of(tree(html, BOILERPLATE))


#: document() as a struct column, and parts of it for those that ask for no more.
parsed = _by_slices(document, StructType().add("title", StringType()).add("text", StringType()).add("sections", _SECTIONS))
titled = _by_slices(title, StringType())
sectioned = _by_slices(sections, _SECTIONS)
quick = _by_slices(quick_text, StringType())
for_questions = _by_slices(question_text, StringType())
