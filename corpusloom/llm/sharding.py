"""Operator 1, sharding by extendible hashing. DataFrame functions only.

A directory maps prefixes of a row's hash to shards. A bucket that holds more bytes than
the limit is split on one more bit of the hash; others are left alone. Splitting stops when
every shard fits, or holds one row.

Rows are hashed by key. Rows that share a key (null keys, repeated ids, a hot key) are told
apart by their content and, if that is the same, by a place that is written once (`common.identified`), after the
key's bits: all passes see the same rows.

Defined cases: null or empty text has 0 bytes; very long texts are counted whole, by their bytes; an empty table gives an empty result; one row
above the limit is a shard of its own, and so are rows that agree in all BITS of the hash (by chance, 2 ** -120 a pair);
repeated rows are rows like others; extra columns are kept, except that columns with the
names of the result's are replaced (names that begin with _loom_ are the operators' own).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, identified, materialize, small

#: Bytes of text in a shard at most. A read unit that also splits the small test tables.
SHARD_BYTES = 1 << 20
#: Bits of the hash in all.
BITS = 2 * WORD
OUT = ("shard_id", "shard_depth", "shard_bytes", "shard_rows")


@dataclass
class Level:
    """Part of the directory: what prefixes of `depth` bits lead to."""

    depth: int
    cells: DataFrame  # p1, p2, leaf_depth (null: a deeper level), leaf_bytes, leaf_rows
    rows: int


def _prefix(h1: Column, h2: Column, depth: Column) -> tuple[Column, Column]:
    """The first `depth` bits of the hash, as its two words."""
    one = F.call_function("shiftright", h1, F.greatest(F.lit(WORD) - depth, F.lit(0)))
    two = F.call_function("shiftright", h2, F.least(F.lit(BITS) - depth, F.lit(WORD)))
    return one, two


def _at(depth: int) -> tuple[Column, Column]:
    one, two = _prefix(F.col("_loom_h1"), F.col("_loom_h2"), F.lit(depth))
    return one.alias("p1"), two.alias("p2")


def _sized(df: DataFrame, key: str, text: str) -> DataFrame:
    return identified(df, key, text).withColumn("_loom_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))


def _descend(cells: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """For each cell at `depth`, its shallowest ancestor below `base` (or itself) that fits."""
    shift = F.lit(depth) - F.col("d")
    up = cells.select("p1", "p2", "bytes", "n", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"))
    # the ancestor's words: cut the second word first, then the first
    two = F.call_function("shiftright", F.col("p2"), F.least(shift, F.lit(max(depth - WORD, 0)))) if depth > WORD else F.lit(0).cast("long")
    one = F.call_function("shiftright", F.col("p1"), F.greatest(F.lit(min(depth, WORD)) - F.col("d"), F.lit(0)))
    up = up.withColumns({"a1": one, "a2": two})
    sums = up.groupBy("d", "a1", "a2").agg(F.sum("bytes").alias("leaf_bytes"), F.sum("n").alias("leaf_rows"))
    fits = sums.where((F.col("leaf_bytes") <= limit) | (F.col("leaf_rows") <= 1) | (F.col("d") >= BITS))
    found = up.select("p1", "p2", "d", "a1", "a2").join(fits, ["d", "a1", "a2"])
    best = found.groupBy("p1", "p2").agg(F.min(F.struct("d", "leaf_bytes", "leaf_rows")).alias("leaf"))
    return cells.join(best, ["p1", "p2"], "left").select(
        "p1", "p2", "bytes", "n", "same", F.col("leaf.d").alias("leaf_depth"), F.col("leaf.leaf_bytes").alias("leaf_bytes"), F.col("leaf.leaf_rows").alias("leaf_rows")
    )


def directory(thin: DataFrame, limit: int = SHARD_BYTES) -> list[Level]:
    """The directory for rows of (_loom_h1, _loom_h2, _loom_bytes). One pass over them for each level; a second level only where a cell is still too large."""
    total = thin.agg(F.sum("_loom_bytes")).first()[0] or 0
    extra = lambda size: max(0, math.ceil(math.log2(max(size, 1) / limit)))
    levels: list[Level] = []
    base, depth, rows = 0, min(WORD, extra(total) + 3), thin
    while True:
        p1, p2 = _at(depth)
        cells = rows.groupBy(p1, p2).agg(F.sum("_loom_bytes").alias("bytes"), F.count("*").alias("n"), (F.min("_loom_h1") == F.max("_loom_h1")).alias("same"))
        level = materialize(_descend(cells, base, depth, limit), "directory")
        found = level.agg(
            F.count("*"), F.max(F.when(F.col("leaf_depth").isNull(), F.col("bytes"))), F.coalesce(F.bool_and(F.when(F.col("leaf_depth").isNull(), F.col("same"))), F.lit(True)), F.count_if(F.col("leaf_depth").isNull())
        ).first()
        levels.append(Level(depth, level, found[0]))
        if not found[3]:
            return levels
        p1, p2 = _at(depth)
        open_cells = level.where("leaf_depth is null").select("p1", "p2")
        rows = rows.withColumns({"p1": p1, "p2": p2}).join(small(open_cells, found[3]), ["p1", "p2"], "left_semi").drop("p1", "p2")
        base = depth
        depth = min(BITS, max(depth + 1, WORD * found[2]) + extra(found[1]) + 2)


def shard(df: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with shard_id (the prefix's bits), shard_depth, shard_bytes and shard_rows. The text isn't shuffled while the directory fits a broadcast."""
    out = _sized(df.drop(*OUT), key, text)
    levels = directory(out.select("_loom_h1", "_loom_h2", "_loom_bytes"), limit)
    for i, level in enumerate(levels):
        p1, p2 = _at(level.depth)
        cells = level.cells.select(
            F.col("p1").alias("_loom_p1"), F.col("p2").alias("_loom_p2"), F.col("leaf_depth").alias(f"_loom_d{i}"), F.col("leaf_bytes").alias(f"_loom_b{i}"), F.col("leaf_rows").alias(f"_loom_n{i}")
        )
        out = out.withColumns({"_loom_p1": p1, "_loom_p2": p2}).join(small(cells, level.rows), ["_loom_p1", "_loom_p2"], "left").drop("_loom_p1", "_loom_p2")
    of = lambda c: F.coalesce(*[F.col(f"_loom_{c}{i}") for i in range(len(levels))])
    one, two = _prefix(F.col("_loom_h1"), F.col("_loom_h2"), F.col("shard_depth"))
    bits = F.concat(
        F.call_function("lpad", F.bin(one), F.least(F.col("shard_depth"), F.lit(WORD)), F.lit("0")),
        F.call_function("lpad", F.bin(two), F.greatest(F.col("shard_depth") - WORD, F.lit(0)), F.lit("0")),
    )
    out = out.withColumn("shard_depth", of("d")).withColumn("shard_id", bits).withColumns({"shard_bytes": of("b"), "shard_rows": of("n")})
    return out.drop("_loom_h1", "_loom_h2", *[f"_loom_{c}{i}" for c in "dbn" for i in range(len(levels))])


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", F.col("_loom_bytes").alias("n_bytes"), *OUT)


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h
  FROM documents),
nodes AS (
  SELECT depth, h >> (60 - depth) AS prefix, SUM(n_bytes)::BIGINT AS shard_bytes, COUNT(*)::BIGINT AS shard_rows
  FROM d, generate_series(0, 40) AS g(depth) GROUP BY ALL),
leaf AS (
  SELECT d.doc_id, MIN(n.depth) AS depth FROM d JOIN nodes n ON n.prefix = (d.h >> (60 - n.depth))
  WHERE n.shard_bytes <= {SHARD_BYTES} OR n.shard_rows <= 1 GROUP BY d.doc_id)
SELECT d.doc_id, d.n_bytes,
       CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(n.prefix), l.depth::INT, '0') END AS shard_id,
       l.depth::INT AS shard_depth, n.shard_bytes, n.shard_rows
FROM d JOIN leaf l ON l.doc_id = d.doc_id JOIN nodes n ON n.depth = l.depth AND n.prefix = (d.h >> (60 - l.depth))
"""
