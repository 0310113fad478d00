"""URL functions: Column expressions over the generic URL syntax (RFC 3986), which never fail on malformed input."""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Scheme, host with port, path, query; the fragment is last.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
#: Extensions that aren't pages.
BINARY = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".mp4", ".mp3", ".zip", ".tar", ".gz", ".bz2", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".css", ".js", ".ico", ".woff", ".woff2", ".ttf", ".eot")
#: The same for the looser rule of question generation.
BINARY_LOOSE = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".zip", ".mp4")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def path(url: Column) -> Column:
    """The path, without parameters of its last segment."""
    return F.regexp_replace(part(url, 3), ";[^/]*$", "")


def normalise(url: Column, always_absolute: bool = False) -> Column:
    """Scheme and host in lower case, no slashes at the end of a path (but of `/`), no parameters, no fragment.

    always_absolute: `://` also where scheme or host is missing.
    """
    scheme, host, query = F.lower(part(url, 1)), F.lower(part(url, 2)), part(url, 4)
    short = F.when(path(url) == "/", F.lit("/")).otherwise(F.regexp_replace(path(url), "/+$", ""))
    if always_absolute:
        head = F.concat(scheme, F.lit("://"), host)
    else:
        head = F.concat(F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))), F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("//"), host)))
    return F.concat(head, short, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"[^/.][^/]*(\.[^./]*)$", 1)


def on_site(url: Column, domain: str) -> Column:
    """Whether the URL is of the domain or one of its www hosts, without a port."""
    return part(url, 1).isin("http", "https") & part(url, 2).rlike(f"^(www[0-9]*[.])?{re.escape(domain)}$")


def admitted(url: Column, domain: str, sign_in: str = "login", sign_in_host: str | None = None) -> Column:
    """Whether a crawl of the domain takes the URL: a page without white space in it or a query right behind the host, and not a sign-in."""
    whole = ~url.rlike(r"\s") & (part(url, 3).startswith("/") | (F.length(part(url, 1)) + F.length(part(url, 2)) + 3 == F.length(url)))
    ok = on_site(url, domain) & whole & ~extension(url).isin(*BINARY) & ~F.contains(F.lower(path(url)), F.lit(sign_in))
    return ok & ~F.contains(url, F.lit(sign_in_host)) if sign_in_host else ok


def admitted_loose(url: Column, domain: str) -> Column:
    """The looser rule: anything that begins on the domain, but for a few extensions at the path's end."""
    ends = F.lower(path(url))
    binary = reduce(lambda a, b: a | b, (F.endswith(ends, F.lit(x)) for x in BINARY_LOOSE))
    begins = part(url, 1).isin("http", "https") & part(url, 2).rlike(f"^(www[0-9]*[.])?{re.escape(domain)}")
    return begins & ~binary


def filename(url: Column) -> Column:
    """Name of the file in which a page is kept."""
    return F.concat(F.substring(F.md5(url), 1, 16), F.lit(".html"))


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def hrefs(html: Column) -> Column:
    """Raw quoted targets of links, without Python."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]+)"'), F.lit(1))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if tag == "a" and k == "href" and v]


def anchors(html: str | None, base: str | None) -> list[str]:
    """Targets of all links of a page, resolved, without fragments; those found so far if the page breaks off."""
    reader = _Anchors()
    try:
        reader.feed(html or "")
    except (ValueError, AssertionError):
        pass
    out = []
    for target in reader.found:
        try:
            out.append(urljoin(base or "", target).partition("#")[0])
        except ValueError:
            continue
    return out


@F.pandas_udf(ArrayType(StringType()))
def links(html: pd.Series, base: pd.Series) -> pd.Series:
    """anchors() as a column."""
    return pd.Series([anchors(h, b) for h, b in zip(html, base, strict=True)], dtype=object)
