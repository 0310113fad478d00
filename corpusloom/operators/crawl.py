"""Breadth-first crawls and reachability. Each level is one pass over its frontier; what was seen is a table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import admitted, admitted_loose, links, normalise
from ..sources.fetch import Archive, Fetcher, fetch
from ..storage import numbered, removed, shuffled_side, written


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): the least number of edges (src, dst) from a seed (node), up to `depth`."""
    seen = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier = seen
    for level in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = written(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # a few written tables
    return seen


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "crawl")


def _first(found: DataFrame, *key: str) -> DataFrame:
    """Of each key the first occurrence by (parent, pos)."""
    return found.groupBy(*key).agg(F.min(F.struct("parent", "pos")).alias("o")).select(*key, "o.parent", "o.pos")


def crawl(
    spark, seeds: list[str], fetcher: Fetcher | Archive, domain: str, budget: int = 5000, stored: DataFrame | None = None, parallel: int | None = None, batch: int = 500, each: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """(url, html) of at most `budget` pages of a domain, those stored by earlier runs included.

    Pages are taken in the order of a queue: by the page that links to them first, then by place in it. Seeds are normalised, links
    also must be admitted. A page that fails counts as visited. A run that goes on rebuilds its frontier from the links of the
    stored pages, after the seeds. Up to `batch` pages are fetched at once, written, and given to `each`, so that a run that ends early has lost no more.
    An archive costs no requests: there the whole frontier is looked up at once, so that a level of links is one pass.
    """
    urls = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "url string, pos int").select(normalise(F.col("url")).alias("url"), F.lit(-1).cast("long").alias("parent"), "pos")
    pages = written(stored.select("url", "html"), "pages") if stored is not None else spark.createDataFrame([], "url string, html string")
    visited = written(pages.select("url"), "visited")
    if stored is not None:
        urls = urls.unionByName(_links(pages.withColumn("parent", F.lit(0).cast("long")), domain))
    frontier = written(_first(urls, "url").join(visited, "url", "left_anti"), "frontier")
    if isinstance(fetcher, Archive):
        return _looked_up(pages, visited, frontier, fetcher, domain, budget, each)
    have, base, parts = pages.count(), 1, [pages]
    while have < budget and not frontier.isEmpty():
        queue = frontier.orderBy("parent", "pos", "url").limit(min(budget - have, batch))
        now = written(queue.withColumn("rank", F.row_number().over(Window.orderBy("parent", "pos", "url"))), "queue")
        got = written(fetch(now, fetcher, parallel).where("html is not null").join(now.select("url", (F.col("rank") + base).cast("long").alias("parent")), "url"), "fetched")
        fresh = got.select("url", "html")
        if each is not None:
            each(fresh)
        base += now.count()
        have += got.count()
        parts.append(fresh)
        if len(parts) == 50:  # plans stay short
            parts = [written(reduce(DataFrame.unionByName, parts), "pages")]
        was = visited, frontier
        visited = written(visited.unionByName(now.select("url")), "visited")
        frontier = written(_first(frontier.unionByName(_links(got, domain)), "url").join(visited, "url", "left_anti"), "frontier")
        for table in was:
            removed(table)
    return reduce(DataFrame.unionByName, parts)


#: Most URLs of a level that are broadcast to the archive's pages; beyond it the pages are shuffled.
LEVEL_URLS = 1 << 18


def _looked_up(pages: DataFrame, visited: DataFrame, frontier: DataFrame, archive: Archive, domain: str, budget: int, each: Callable[[DataFrame], None] | None) -> DataFrame:
    """crawl() of an archive, level by level. The queue's order decides which pages the budget has room for; pages beyond it end the crawl, so none is missed.

    Only URLs are put in order; a page's text moves when it is looked up and written.
    """
    have, base, parts, levels = pages.count(), 1, [pages], [visited]
    known = written(archive.pages.where("html is not null").select("url"), "known")
    while have < budget and not frontier.isEmpty():
        hits = numbered(frontier.join(shuffled_side(known), "url", "left_semi"), ["parent", "pos", "url"], "rank").where(F.col("rank") < budget - have)
        now = written(hits.select("url", (F.col("rank") + base).alias("parent")), "queue")
        n = now.count()
        got = written(archive.pages.select("url", "html").join(F.broadcast(now) if n <= LEVEL_URLS else shuffled_side(now), "url"), "fetched")
        fresh = got.select("url", "html")
        if each is not None:
            each(fresh)
        have, base = have + n, base + n
        parts.append(fresh)
        levels.append(frontier.select("url"))
        if len(parts) == 50:  # plans stay short
            parts, levels = [written(reduce(DataFrame.unionByName, parts), "pages")], [written(reduce(DataFrame.unionByName, levels), "visited")]
        if have < budget:
            seen = shuffled_side(reduce(DataFrame.unionByName, levels))
            frontier = written(_first(_links(got, domain), "url").join(seen, "url", "left_anti"), "frontier")
    return reduce(DataFrame.unionByName, parts)


def _links(pages: DataFrame, domain: str) -> DataFrame:
    """(url, parent, pos) of the admitted links of (url, html, parent)."""
    found = pages.select("parent", F.posexplode(links(F.coalesce("html", F.lit("")), "url")).alias("pos", "link")).select(normalise(F.col("link")).alias("url"), "parent", "pos")
    return found.where(admitted(F.col("url"), domain))


def crawl_categories(spark, categories: DataFrame, fetcher: Fetcher | Archive, domain: str, default_cap: int = 10) -> DataFrame:
    """(category, url, html): for (category, seeds, cap), a crawl of each in the order of a queue, all at once, level by level; failures count against the cap."""
    caps = categories.select("category", F.coalesce("cap", F.lit(default_cap)).alias("cap"))
    trim = F.rtrim(F.col("url"), F.lit("/"))
    seeds = categories.select("category", F.posexplode("seeds").alias("pos", "url")).select("category", trim.alias("url"), F.lit(0).cast("long").alias("parent"), "pos")
    frontier = _kept(_first(seeds, "category", "url"))
    visited, pages, base = None, None, 0
    turn = Window.partitionBy("category").orderBy("parent", "pos", "url")
    while not frontier.isEmpty():
        used = visited.groupBy("category").agg(F.count("*").alias("used")) if visited is not None else caps.select("category", F.lit(0).alias("used"))
        room = caps.join(used, "category", "left").select("category", (F.col("cap") - F.coalesce("used", F.lit(0))).alias("room"))
        now = _kept(frontier.withColumn("rank", F.row_number().over(turn)).join(room, "category").where("rank <= room").select("category", "url", "rank"))
        if now.isEmpty():
            break
        got = _kept(now.join(fetch(now.select("url").distinct(), fetcher), "url").where("html is not null"))
        pages = _kept(got.select("category", "url", "html") if pages is None else pages.unionByName(got.select("category", "url", "html")))
        visited = _kept(now.select("category", "url") if visited is None else visited.unionByName(now.select("category", "url")))
        found = got.select("category", (F.col("rank") + base).cast("long").alias("parent"), F.posexplode(links("html", "url")).alias("pos", "url"))
        found = found.select("category", trim.alias("url"), "parent", "pos").where(admitted_loose(F.col("url"), domain))
        base += now.agg(F.max("rank")).first()[0]
        frontier = _kept(_first(frontier.unionByName(found), "category", "url").join(visited, ["category", "url"], "left_anti"))
    return pages if pages is not None else spark.createDataFrame([], "category string, url string, html string")
