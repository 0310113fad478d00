"""Fetching pages. The fetcher is injected, so that everything but the network can be tested."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Fetcher = Callable[[str], str | None]
USER_AGENT = "Mozilla/5.0 (compatible; corpusloom)"


def http_fetcher(timeout: float = 10.0) -> Fetcher:
    """GET as UTF-8 with replacement; None on any failure."""

    def fetch(url: str) -> str | None:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT}), timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")
        except (OSError, ValueError):
            return None

    return fetch


@dataclass(frozen=True)
class Archive:
    """Pages that are there already as a table (url, html), one row a URL, in place of a fetcher: they are looked up by a join."""

    pages: DataFrame


def fetch(urls: DataFrame, fetcher: Fetcher | Archive, partitions: int | None = None) -> DataFrame:
    """(url, html) for (url): one request a row, or one join; html is null if it failed. partitions bounds the requests at one time."""
    if isinstance(fetcher, Archive):
        return urls.select("url").join(fetcher.pages.select("url", "html"), "url", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"url": pdf.url, "html": [fetcher(u) for u in pdf.url]})

    rows = urls.select("url")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, "url string, html string")


def polite(call: Callable[[str], str | None], delay: float) -> Callable[[str], str | None]:
    """The same call, with a pause after each one."""

    def run(x: str) -> str | None:
        try:
            return call(x)
        finally:
            time.sleep(delay)

    return run
