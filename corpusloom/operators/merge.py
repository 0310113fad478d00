"""Keyed corpora: first and last wins, union by priority, pending and missing keys, assembly with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalise, without_query


def _one(rows: DataFrame, key: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(pick(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def last_wins(rows: DataFrame, *key: str, order: str = "ord") -> DataFrame:
    """Of each key the row with the largest order. Partial aggregation; no sort."""
    return _one(rows, list(key), order, F.max_by)


def first_wins(rows: DataFrame, *key: str, order: str = "ord") -> DataFrame:
    return _one(rows, list(key), order, F.min_by)


def by_priority(primary: DataFrame, secondary: DataFrame, *key: str, order: str = "ord") -> DataFrame:
    """The last row of each key of the primary corpus; and of keys that it lacks, the first of the secondary. One aggregation over both; `order` may be of any type that has an order."""
    rest = [c for c in primary.columns if c not in key]
    both = primary.withColumn("_first", F.lit(True)).unionByName(secondary.withColumn("_first", F.lit(False)))
    row = F.struct(*rest)
    last, first = F.max_by(row, F.when(F.col("_first"), F.col(order))), F.min_by(row, F.when(~F.col("_first"), F.col(order)))
    best = both.groupBy(*key).agg(F.coalesce(last, first).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def pending(docs: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    return docs.join(done.select(*key).distinct(), list(key), "left_anti")


def finished(docs: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """The log's rows of documents that are in it."""
    return done.join(docs.select(*key).distinct(), list(key), "left_semi")


def assembled(docs: DataFrame, done: DataFrame, key: str, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs with the log's value of each column where it has one."""
    logged = done.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    rows = docs.join(logged, key, "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in docs.columns])


def missing(urls: DataFrame, corpus: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs that the corpus has neither as they are nor without their query, both normalised."""
    known = corpus.select(normalise(F.col(url), True).alias("_known")).distinct()
    full: Column = normalise(F.col(url), True)
    bare: Column = normalise(without_query(F.col(url)), True)
    asked = urls.select(url).distinct()
    left = asked.join(known, full == F.col("_known"), "left_anti")
    return left.join(known, bare == F.col("_known"), "left_anti")


def counters(rows: DataFrame, **conditions: str) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return rows.agg(*[F.count_if(F.expr(c)).alias(name) for name, c in conditions.items()])
