"""Operator 9, main text of web pages by wrapper induction.

Pages of one host are made from one template. Up to SAMPLE pages of a host, drawn by hash, are parsed to trees of
block elements and folded, whole, into one tree by simple tree matching: two nodes match if their tag and classes do, and the ordered
matching of their children is the largest. Every page of the table is aligned with its host's tree, and what is met in each
slot is summed over all distinct pages of the host: on how many pages, how much text, how much of it in links, and which texts. Then
each slot is judged (`judge`):

- a text on CONSTANT_SHARE of the pages is constant, and belongs to the template;
- a slot on CONSTANT_SHARE of the pages whose text is mostly links, several of them, is a menu;
- a slot whose element or class says that it is no part of an article is none, unless most of the host's text is in it (then it names a layout);
- from the root down, the slot that holds most of the text that varies and isn't in links is the main one, where an article or main
  element counts for more, and a sibling with the page's heading keeps the level above. What is outside the main slot belongs to the template.

Each page is then aligned once more, and each of its nodes gets its slot's judgement. Nodes without a slot are judged by
their own element and classes. Within an article a class counts only if all its words do, as others speak of what the article is about
(`related-work`), and words in a line of text go only if they are hidden or an advert's. So are pages of hosts without a template and pages without the main slot: of these the article
element, or else the main element, or else all is read, without what elements and classes mark as no part of an article.

Trees of SAMPLE pages bound a template: the sample gives its slots and the texts that are counted, those on two or more
sampled pages; the judgements are from sums over all pages. The templates are broadcast within a checked size, else joined by host; AQE splits a
host with a third of all pages. Nodes with very many children are aligned by the same rule as others.

Defined cases: null, empty and text-less html gives an empty text; very long pages are read whole; elements nested more than NESTING deep
are read as siblings, as browsers do; pages without a host, and those of hosts of fewer than MINIMUM distinct pages, have no template; cut off
pages are read as far as they go; repeated pages count once for a template and are read alike; of matchings of one size the one that ties to the
end is taken; an empty table gives an empty result; extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, small

#: Pages of a host whose trees are folded, at most; and distinct pages that it has at least, for constant slots.
SAMPLE = 16
MINIMUM = 8
#: Share of a host's distinct pages on which a slot has the same text if it is constant, and on which a menu is.
CONSTANT_SHARE = 0.75
#: Share of links in a menu's text, and texts that it has on a page at least.
LINK_SHARE, MENU_TEXTS = 0.7, 3
#: Share of the varying text that the main slot holds of the one above it; and of article elements together.
MAIN_SHARE, ARTICLE_SHARE = 0.7, 0.3
#: Pairs of children beyond which they are aligned by vectors, with the same result, and how deep elements are nested.
CELLS = 400
NESTING = 500
#: Judgements of slots: part of the article, part of the template, above the main slot, beside it, the main slot.
KEPT, GONE, ABOVE, BESIDE, MAIN = range(5)
#: Shapes and pairs of them that are kept for a template from page to page.
SHAPES = 20_000

#: Elements of HTML without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is text up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements within a line of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are no part of an article's text.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "math", "object", "embed", "button", "select", "textarea", "input", "head", "title", "dialog", "menu", "audio", "video", "canvas", "xmp", "noembed", "noframes", "link", "meta", "base"}
#: Words in class, id and role that mark such parts.
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "popup", "modal", "footer", "masthead", "toolbar", "topbar", "topnav", "sidenav", "pagination", "pager", "widget", "contentinfo", "complementary", "search", "adsbygoogle", "copyright", "disclaimer", "login", "signup", "signin", "skip"}
#: Of these, what readers wrote; the ones that also mark an article element as none; and words beside which `header` means a part of the article.
READER_WORDS = {"comment", "comments", "commentlist", "disqus"}
COMMENT_WORDS = {"ad", "ads", "advert", "sponsored", "promo", "related", "recommended", "teaser"}
ARTICLE_WORDS = {"article", "entry", "post", "content", "story", "section"}
#: Words that name no content, beside which the words above keep their sense: `related-posts` names a list, `related-work` a section of an article.
PLAIN_WORDS = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "center", "col", "column", "container", "content", "desktop", "div", "entry", "entries", "fixed", "form", "global", "grid", "group", "header", "holder", "icon", "icons", "inline", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "mobile", "module", "news", "outer", "page", "pane", "panel", "placeholder", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "stories", "story", "articles", "article", "text", "title", "top", "unit", "ul", "wrap", "wrapper", "zone", "to", "us", "me", "this"}
#: Of these the ones that hide words in a line; and classes of elements that are an article's body without being an article element.
ADVERT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "adsbygoogle"}
ARTICLE_NAMES = {"article", "article-body", "article-content", "article-text", "entry-content", "post-body", "post-content", "story-body"}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_attribute = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_word = re.compile(r"[a-z]+")


class Node:
    """A block element (tag, signature, children) or a run of text in one (tag empty). aside: 2 if its tag marks it as no part of an article or it is what readers wrote, 1 if other classes mark it. links: characters of the text in links."""

    __slots__ = ("tag", "sign", "children", "text", "aside", "links")

    def __init__(self, tag: str, sign: str = "", text: str = "", aside: int = 0, links: int = 0):
        self.tag, self.sign, self.text, self.aside, self.links, self.children = tag, sign or tag, text, aside, links, []


def _closes(tag: str, opened: str) -> bool:
    """Whether a start tag ends an open element of that name."""
    if opened == "p":
        return tag not in INLINE
    if opened in ("li", "dt", "dd", "option"):
        return tag == opened or (opened in ("dt", "dd") and tag in ("dt", "dd"))
    if opened in ("td", "th"):
        return tag in ("td", "th", "tr", "tbody", "tfoot", "thead")
    if opened == "tr":
        return tag in ("tr", "tbody", "tfoot", "thead")
    return opened == "head" and tag == "body"


def _aside(tag: str, words: set[str], names: dict[str, str], stack: list[Node]) -> int:
    if tag == "header" and any(n.tag in ("article", "main") for n in stack):
        return 0  # the article's own
    if tag in ASIDE_TAGS or (words & READER_WORDS and tag not in ("html", "body", "main")) or _hidden(names):
        return 2
    if tag in ("html", "body", "main") or not words:
        return 0
    if tag == "article":
        return int(bool(words & COMMENT_WORDS))
    if any(n.tag == "article" or ARTICLE_NAMES & set(n.sign.split(".")[1:]) for n in stack):
        # within an article a name counts only as a whole: other words in it speak of what the article is about
        return int(any(part & ASIDE_WORDS and part <= ASIDE_WORDS | PLAIN_WORDS for part in _names(names)))
    return int(bool(words & ASIDE_WORDS) or ("header" in words and not words & ARTICLE_WORDS))


def _names(names: dict[str, str]) -> list[set[str]]:
    """The words of each class, id and role of an element."""
    return [set(_word.findall(x)) for a in ("class", "id", "role") for x in names.get(a, "").split()]


def _hidden(names: dict[str, str]) -> bool:
    return "hidden" in names or "display:none" in names.get("style", "").replace(" ", "")


def parse(html: str) -> Node:
    """The tree of block elements of a page, however broken."""
    root = Node("#root")
    stack, runs = [root], []
    inline: list[tuple[str, bool]] = []  # open inline elements, and whether they hide their text
    hidden = linked = 0  # depth of hidden elements; characters of the run in links

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join(unescape("".join(runs)).split())
            if text:
                stack[-1].children.append(Node("", "#", text, links=min(linked, len(text))))
            runs.clear()
        linked = 0

    def say(run: str) -> None:
        nonlocal linked
        if not hidden:
            runs.append(run)
            if inline and any(tag == "a" for tag, _ in inline):
                linked += len(run.strip())

    at = 0
    while True:
        found = _token.search(html, at)
        if found is None:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in INLINE:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == tag:
                        hidden -= sum(h for _, h in inline[i:])
                        del inline[i:]
                        break
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    flush()
                    del stack[i:]
                    hidden, inline = 0, []
                    break
            continue
        raw = found[3]
        names: dict[str, str] = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _attribute.finditer(raw)} if raw and not raw.isspace() else {}
        words = set(_word.findall(f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}")) if names else set()
        aside = _aside(tag, words, names, stack)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                runs.append(" " if tag == "br" and not hidden else "")
            elif not raw.rstrip().endswith("/"):
                # words in a line go if they are hidden or an advert's, by no other class
                gone = _hidden(names) or any(part <= ADVERT_WORDS for part in _names(names) if part)
                inline.append((tag, gone))
                hidden += gone
            continue
        flush()
        inline, hidden = [], 0
        while len(stack) > 1 and _closes(tag, stack[-1].tag):
            stack.pop()
        if tag in VOID:
            continue
        node = Node(tag, f"{tag}.{'.'.join(sorted(names.get('class', '').split()))}", aside=aside)
        stack[-1].children.append(node)
        if not raw.endswith("/") and len(stack) < NESTING:
            stack.append(node)
    flush()
    return root


def _key(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


class Shapes:
    """Numbers for trees of signs, and the sizes of the largest matchings between them. Nodes of one shape match alike, so each pair of shapes is settled once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.signs, self.kids, self.nodes = [], [], []  # by shape
        self.weights: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by slot's number and node's shape
        self.a: dict[int, int] = {}  # shapes of nodes by identity, of either side
        self.b: dict[int, int] = {}

    def of(self, node, sign, kids, known: dict[int, int]) -> int:
        got = known.get(id(node))
        if got is None:
            below = tuple([self.of(k, sign, kids, known) for k in kids(node)])
            key = (sign(node), below)
            got = self.numbers.get(key)
            if got is None:
                got = self.numbers[key] = len(self.signs)
                self.signs.append(key[0])
                self.kids.append(below)
                self.nodes.append(1 + sum(self.nodes[k] for k in below))
            known[id(node)] = got
        return got

    def weight(self, x: int, y: int) -> int:
        """Size of the largest matching of two trees by their roots; 0 if these don't match."""
        if x == y:
            return self.nodes[x]
        if self.signs[x] != self.signs[y]:
            return 0
        got = self.weights.get((x, y))
        if got is None:
            got = self.weights[x, y] = 1 + self.match(self.kids[x], self.kids[y], False)[0]
        return got

    def match(self, a: Sequence[int], b: Sequence[int], paired: bool = True) -> tuple[int, list[tuple[int, int]]]:
        """The size of the largest ordered matching of two lists of shapes, and its pairs; of equal ones that which ties to the end."""
        if not a or not b:
            return 0, []
        return self._by_cells(a, b, paired) if len(a) * len(b) <= CELLS else self._by_rows(a, b, paired)

    def _by_cells(self, a, b, paired):
        m, n = len(a), len(b)
        rows = {x: [self.weight(x, y) for y in b] for x in set(a)}
        best = [[0] * (n + 1)]
        for i in range(m):
            row, above, w = [0] * (n + 1), best[i], rows[a[i]]
            for j in range(n):
                v = above[j] + w[j] if w[j] else 0
                row[j + 1] = max(v, above[j + 1], row[j])
            best.append(row)
        pairs: list[tuple[int, int]] = []
        i, j = (m, n) if paired else (0, 0)
        while i and j:
            w = rows[a[i - 1]][j - 1]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        pairs.reverse()
        return best[m][n], pairs

    def _by_rows(self, a, b, paired):
        """The same for long lists: a vector for each node of the shorter one, of which every so many are kept and the rest made again."""
        turned = len(b) < len(a)
        few, many = (b, a) if turned else (a, b)
        distinct = {y: k for k, y in enumerate(dict.fromkeys(many))}
        at = np.array([distinct[y] for y in many])
        rows = {x: np.array([self.weight(y, x) if turned else self.weight(x, y) for y in distinct], np.int64)[at] for x in set(few)}

        def after(above: np.ndarray, x: int) -> np.ndarray:
            w, row = rows[x], np.zeros(len(many) + 1, np.int64)
            np.maximum.accumulate(np.maximum(np.where(w > 0, above[:-1] + w, 0), above[1:]), out=row[1:])
            return row

        step = math.isqrt(len(few)) + 1
        row = np.zeros(len(many) + 1, np.int64)
        kept = [row]
        for k, x in enumerate(few, 1):
            row = after(row, x)
            if k % step == 0:
                kept.append(row)
        size = int(row[-1])
        pairs: list[tuple[int, int]] = []
        s, t = (len(few), len(many)) if paired else (0, 0)  # places in few and in many
        first, block = len(few) + 1, []
        while s and t:
            if s - 1 < first:
                first = (s - 1) // step * step
                block = [kept[first // step]]
                for x in few[first:s]:
                    block.append(after(block[-1], x))
                block = [r.tolist() for r in block]
            here, above = block[s - first], block[s - 1 - first]
            w = int(rows[few[s - 1]][t - 1])
            if w and here[t] == above[t - 1] + w:
                pairs.append((t - 1, s - 1) if turned else (s - 1, t - 1))
                s, t = s - 1, t - 1
            elif turned:
                # the row of a's last node is left first
                if here[t] == here[t - 1]:
                    t -= 1
                else:
                    s -= 1
            elif here[t] == above[t]:
                s -= 1
            else:
                t -= 1
        pairs.reverse()
        return size, pairs


def align(a: list, b: list, sign_a, sign_b, kids_a, kids_b, shapes: Shapes | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two ordered lists of nodes: the size of the largest matching, and its pairs at this level."""
    if not a or not b:
        return 0, []
    _deep()
    shapes = shapes or Shapes()
    return shapes.match([shapes.of(x, sign_a, kids_a, shapes.a) for x in a], [shapes.of(x, sign_b, kids_b, shapes.b) for x in b])


class Slot:
    """A node of a template. texts: characters of the texts that are counted, by crc32. While pages are folded, pages and asides count them and met counts texts."""

    __slots__ = ("sign", "children", "texts", "aside", "verdict", "number", "pages", "asides", "met")

    def __init__(self, sign: str):
        self.sign, self.children, self.texts, self.aside, self.verdict, self.number = sign, [], {}, 0, KEPT, 0
        self.pages, self.asides, self.met = 0, [0, 0, 0], Counter()

    def packed(self) -> list:
        return [self.sign, [[k, n] for k, n in sorted(self.texts.items())], self.aside, self.verdict, [c.packed() for c in self.children]]

    @classmethod
    def unpacked(cls, packed: list) -> Slot:
        slot = cls(packed[0])
        slot.texts, slot.aside, slot.verdict = dict(packed[1]), packed[2], packed[3]
        slot.children = [cls.unpacked(c) for c in packed[4]]
        return slot

    def all(self) -> list[Slot]:
        """This slot and those below, numbered in a fixed order, parents first."""
        out, stack = [], [self]
        while stack:
            slot = stack.pop()
            slot.number = len(out)
            out.append(slot)
            stack += slot.children
        return out


def _sign(x: Slot | Node) -> str:
    return x.sign


def _kids(x: Slot | Node) -> list:
    return x.children


def _fold(slot: Slot, node: Node, shapes: Shapes) -> None:
    """Adds a page's node, which matches the slot, to the template. shapes: of this page; slots keep theirs until they are reached."""
    stack = [(slot, node)]
    while stack:
        slot, node = stack.pop()
        slot.pages += 1
        slot.asides[node.aside] += 1
        if node.text:
            slot.met[_key(node.text)] += 1
            slot.texts[_key(node.text)] = len(node.text)
        matched = {j: i for i, j in align(slot.children, node.children, _sign, _sign, _kids, _kids, shapes)[1]}
        new, i = [], 0
        for j, kid in enumerate(node.children):
            if j in matched:
                new += slot.children[i : matched[j]]
                i = matched[j] + 1
                here = slot.children[matched[j]]
            else:
                here = Slot(kid.sign)
            stack.append((here, kid))
            new.append(here)
        slot.children = new + slot.children[i:]


def _deep() -> None:
    """Trees as deep as NESTING are walked by recursion."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * NESTING))


def induce(pages: list[str]) -> str:
    """The folded tree of a host's sampled pages, as JSON, with the texts that are on more than one of them."""
    _deep()
    root = Slot("#root")
    for html in pages:
        _fold(root, parse(html), Shapes())
    for slot in root.all():
        slot.texts = {k: n for k, n in slot.texts.items() if slot.met[k] > 1}
        slot.aside = max((level for level in (1, 2) if 2 * sum(slot.asides[level:]) >= slot.pages), default=0)
    return json.dumps(root.packed(), separators=(",", ":"))


def _hit(number: int, text: int) -> int:
    return number << 32 | text


class Template:
    """A folded tree to align pages with."""

    def __init__(self, made: str):
        _deep()
        self.root = Slot.unpacked(json.loads(made))
        self.slots = self.root.all()
        self.shapes = Shapes()

    def matched(self, page: Node) -> list[tuple[Slot, Node]]:
        """The slots of a page's nodes, those that have one."""
        shapes = self.shapes
        shapes.b = {}
        if len(shapes.numbers) + len(shapes.weights) + len(shapes.pairs) > SHAPES:
            shapes.clear()
        shapes.of(page, _sign, _kids, shapes.b)
        out, at = [(self.root, page)], 0
        while at < len(out):
            slot, node = out[at]
            at += 1
            if slot.children and node.children:
                key = slot.number, shapes.b[id(node)]
                pairs = shapes.pairs.get(key)
                if pairs is None:
                    a = [shapes.of(c, _sign, _kids, shapes.a) for c in slot.children]
                    pairs = shapes.pairs[key] = shapes.match(a, shapes.kids[key[1]])[1]
                out += [(slot.children[i], node.children[j]) for i, j in pairs]
        return out


def judge(made: str, pages: int, sums: dict[int, tuple[int, int, int]], hits: dict[int, int]) -> str:
    """The template with its slots' judgements, and only constant texts. pages: distinct ones of the host; sums: pages, characters and those in links by slot; hits: pages by slot and text."""
    template = Template(made)
    slots = template.slots
    for s in slots:
        s.texts = {k: n for k, n in s.texts.items() if hits.get(_hit(s.number, k), 0) >= CONSTANT_SHARE * pages}
    met, chars, links, texts, varying = ([0] * len(slots) for _ in range(5))
    article, heading = [False] * len(slots), [0] * len(slots)
    tag = [s.sign.split(".")[0] for s in slots]
    for s in reversed(slots):  # children first
        k = s.number
        met[k], own, linked = sums.get(k, (0, 0, 0))
        constant = sum(n * hits[_hit(k, t)] for t, n in s.texts.items())
        chars[k], links[k], texts[k] = own, linked, met[k] if own else 0
        varying[k] = max(0, own - constant - linked)
        for c in s.children:
            j = c.number
            chars[k], links[k], texts[k], varying[k] = chars[k] + chars[j], links[k] + links[j], texts[k] + texts[j], varying[k] + varying[j]
        article[k] = not s.aside and (tag[k] in ("article", "main") or any(article[c.number] for c in s.children))
    everything = varying[0]

    def gone(s: Slot) -> bool:
        k = s.number
        if s.aside == 2 or (s.aside == 1 and not article[k] and 2 * varying[k] < everything):
            return True
        menu = met[k] >= CONSTANT_SHARE * pages and links[k] >= LINK_SHARE * chars[k] and texts[k] >= MENU_TEXTS * met[k]
        return menu and 2 * varying[k] < everything

    stack, kept = [template.root], []
    while stack:  # parents first
        s = stack.pop()
        kept.append(s)
        for c in s.children:
            if gone(c):
                c.verdict = GONE
                below = c.children.copy()
                while below:
                    x = below.pop()
                    x.verdict = GONE
                    below += x.children
            else:
                stack.append(c)
    weight = [0] * len(slots)
    for s in reversed(kept):
        k = s.number
        own = varying[k] - sum(varying[c.number] for c in s.children)
        weight[k] = own + sum(weight[c.number] for c in s.children)
        level = {"h1": 2, "h2": 1}.get(tag[k], 0) if weight[k] and 2 * met[k] >= pages else 0
        heading[k] = max([level, *(heading[c.number] for c in s.children if c.verdict != GONE)])
    title = heading[0]

    def telling(s: Slot) -> list[Slot]:
        return [c for c in s.children if c.verdict != GONE and weight[c.number]]

    def branches(s: Slot) -> bool:
        while len(now := telling(s)) == 1:
            s = now[0]
        return len(now) > 1

    here, main, above = template.root, [], []
    while not main:
        kids = telling(here)
        total = sum(weight[c.number] for c in kids)
        named = [c for c in kids if article[c.number]]
        most = max(kids, key=lambda c: weight[c.number], default=None)
        if tag[here.number] in ("article", "main") or not kids:
            main = [here]
        elif named and sum(weight[c.number] for c in named) >= ARTICLE_SHARE * total and (len(named) == 1 or all(tag[c.number] in ("article", "main") for c in named)):
            above.append(here)
            if all(tag[c.number] in ("article", "main") for c in named):
                main = named
            else:
                here = named[0]
        elif weight[most.number] >= MAIN_SHARE * total and branches(most) and not any(heading[c.number] == title > 0 for c in kids if c is not most):
            above.append(here)
            here = most
        else:
            main = [here]
    for s in kept:
        s.verdict = BESIDE
    stack = list(main)
    while stack:
        s = stack.pop()
        if s.verdict != GONE:
            s.verdict = KEPT
            stack += s.children
    for s in above:
        s.verdict = ABOVE
    for s in main:
        s.verdict = MAIN
    return json.dumps(template.root.packed(), separators=(",", ":"))


def _scope(root: Node) -> Node:
    """What is read of a page: a root over its article elements, or else its main elements, or else all of it.

    Parts that only their classes mark are searched if there is no such element elsewhere: a layout's classes may name its sidebar.
    """
    for wanted in ("article", "main"):
        for least in (1, 2):
            found, stack = [], [root]
            while stack:
                node = stack.pop()
                if node.aside >= least:
                    continue
                if node.tag == wanted and not node.aside:
                    found.append(node)
                else:
                    stack += reversed(node.children)
            if found:
                top = Node("#root")
                top.children = found
                return top
    return root


def _blocks(page: Node, least: int) -> list[str]:
    blocks, walk = [], [page]
    while walk:
        node = walk.pop()
        if node.aside >= least:
            continue
        if node.text:
            blocks.append(node.text)
        walk += reversed(node.children)
    return blocks


def by_template(page: Node, template: Template) -> list[str] | None:
    """The blocks of a page that its template keeps; None if the main slot isn't met."""
    slots = {id(node): slot for slot, node in template.matched(page)}
    if not any(slot.verdict == MAIN for slot in slots.values()):
        return None
    blocks, walk = [], [(page, False)]
    while walk:
        node, inside = walk.pop()
        slot = slots.get(id(node))
        if slot is None:
            if node.aside or not inside:
                continue
        elif slot.verdict in (GONE, BESIDE) or (node.text and _key(node.text) in slot.texts):
            continue
        else:
            inside = inside or slot.verdict == MAIN
        if node.text and inside:
            blocks.append(node.text)
        walk += [(c, inside) for c in reversed(node.children)]
    return blocks


def extract(html: str | None, template: Template | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = parse(html)
    blocks = by_template(page, template) if template is not None else None
    if blocks is None:
        page = _scope(page)
        # where classes mark all there is, they speak of the layout
        blocks = _blocks(page, 1) or _blocks(page, 2)
    return "\n".join(blocks)


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _by_template(rows: DataFrame, known: DataFrame, each: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str) -> DataFrame:
    """each(batch, templates of its rows) over rows with a column host. The templates are broadcast within a checked size, else joined."""
    size = known.agg(F.sum(F.length("template") + F.length("host") + 64)).first()[0] or 0
    by_host = None
    if size <= BROADCAST_BYTES:
        by_host = rows.sparkSession.sparkContext.broadcast({r.host: r.template for r in known.collect()})
        rows = rows.withColumn("template", F.lit(None).cast("string"))
    else:
        rows = rows.join(known, "host", "left")

    def run(batches):
        parsed: dict[str, Template | None] = {}
        for batch in batches:
            found = []
            for name, template in zip(batch.column("host").to_pylist(), batch.column("template"), strict=True):
                if name not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    made = by_host.value.get(name) if by_host is not None else template.as_py()
                    parsed[name] = Template(made) if made else None
                found.append(parsed[name])
            yield each(batch, found)

    return rows.mapInArrow(run, schema)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of the hosts with MINIMUM distinct pages or more."""
    rows = pages.select(host().alias("host"), F.col("html")).where("html is not null and host <> ''").withColumn("draw", F.xxhash64("html"))
    # the draws that can be among a host's smallest: some four times SAMPLE, so that a host's draws can be ranked in one task; copies count once
    counts = rows.select("host", "draw").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MINIMUM)
    counts = materialize(counts, "hosts")
    n_hosts = counts.count()
    below = (F.pmod(F.col("draw"), F.lit(1 << 20)) / (1 << 20)) < 4.0 * SAMPLE / F.col("n")
    drawn = rows.select("host", "draw").join(small(counts, n_hosts, 96), "host").where(below).select("host", "draw").distinct()
    few = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy("draw"))).where(F.col("rank") <= SAMPLE)
    few = materialize(few.select("host", "draw"), "sample", few_files=True)
    chosen = rows.join(small(few, SAMPLE * n_hosts, 96), ["host", "draw"]).groupBy("host", "draw").agg(F.first("html").alias("html"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "template": [induce(list(pdf.sort_values("draw").html))]})

    folded = materialize(chosen.groupBy("host").applyInPandas(build, "host string, template string"), "folded")

    def measure(batch: pa.RecordBatch, found: list[Template | None]) -> pa.RecordBatch:
        columns: list[list[list[int]]] = [[], [], [], []]
        for html, template in zip(batch.column("html").to_pylist(), found, strict=True):
            pairs = template.matched(parse(html)) if template else []
            columns[0].append([slot.number for slot, _ in pairs])
            columns[1].append([len(node.text) for _, node in pairs])
            columns[2].append([node.links for _, node in pairs])
            columns[3].append(sorted(_hit(slot.number, key) for slot, node in pairs if node.text and (key := _key(node.text)) in slot.texts))
        lists = [pa.array(c, pa.list_(pa.int64())) for c in columns]
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("draw"), *lists], ["host", "draw", "slots", "chars", "links", "hits"])

    met = _by_template(rows, folded, measure, "host string, draw long, slots array<long>, chars array<long>, links array<long>, hits array<long>")
    met = materialize(met.where("size(slots) > 0").groupBy("host", "draw").agg(*[F.first(c).alias(c) for c in ("slots", "chars", "links", "hits")]), "met")
    sums = met.select("host", F.explode(F.arrays_zip("slots", "chars", "links")).alias("x")).groupBy("host", F.col("x.slots").alias("slot"))
    sums = sums.agg(F.count("*").alias("n"), F.sum("x.chars").alias("chars"), F.sum("x.links").alias("links"))
    hits = met.select("host", F.explode("hits").alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n")).withColumns({"chars": F.lit(-1).cast("long"), "links": F.lit(0).cast("long")})
    known = sums.unionByName(hits).groupBy("host").agg(F.collect_list(F.struct("slot", "n", "chars", "links")).alias("found")).join(small(counts, n_hosts, 96), "host")

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for template, n, found in zip(pdf.template, pdf.n, pdf.found, strict=True):
                sums = {x["slot"]: (x["n"], x["chars"], x["links"]) for x in found if x["chars"] >= 0}
                made.append(judge(template, int(n), sums, {x["slot"]: x["n"] for x in found if x["chars"] < 0}))
            yield pd.DataFrame({"host": pdf.host, "template": made})

    return folded.join(known, "host").select("host", "template", "n", "found").mapInPandas(judged, "host string, template string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    known = materialize(templates(pages), "templates")

    def read(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        texts = [extract(html, template) for html, template in zip(batch.column("html").to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host().alias("host"))
    return _by_template(rows, known, read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _decoded(x: str) -> str:
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        x = f"regexp_replace({x}, '&{entity};?', '{char}', 'g')"
    return x


#: The same for pages as the shared tables have them, of one article of headings and paragraphs, none of it constant on a host.
OP9_SQL = f"""
WITH a AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'), '(?:<h1>|<p><b>|<p>)([^<]*)', 1) AS p FROM pages),
b AS (SELECT page_id, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM a),
c AS (SELECT page_id, pos, trim(regexp_replace({_decoded("x")}, '\\s+', ' ', 'g')) AS t FROM b),
t AS (SELECT page_id, string_agg(t, chr(10) ORDER BY pos) AS text FROM c WHERE t <> '' GROUP BY page_id)
SELECT page_id, url, COALESCE(text, '') AS text, length(COALESCE(text, '')) AS n_chars FROM pages LEFT JOIN t USING (page_id)
"""
