"""Helpers shared by the training-data operators: size-checked broadcasts, row identities, components; and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, numbered  # noqa: F401  for the operators
from ..storage import removed as discard
from ..storage import written as materialize

#: Most bytes of a join side that may be broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bits in each of the two words of a row hash.
WORD = 60
#: A word as the task contracts define it, in the syntax of Java and DuckDB regular expressions.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """A broadcast hint if `rows` rows of `row_bytes` are within the bound, else df as it is (a shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def n_words(text: str | Column) -> Column:
    """Number of contract words; 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def identified(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with _loom_h1 and _loom_h2, two words of WORD bits that tell its rows apart and are the same however often df is computed.

    The first is of the key alone, the second of what still tells apart rows with that key: their text. Rows that repeat in key and
    text can only be told apart by a place. Places depend on how a plan happens to be cut, so these rows are written with theirs to the
    shared folder, once, and read from there; all others stay where they are. Rows that agree in all bits (2 ** -120 a pair) are not told apart.
    """
    known = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    first = F.conv(F.substring(F.md5(known), 1, WORD // 4), 16, 10).cast("long")
    rows = df.withColumns({"_loom_h1": first, "_loom_h2": F.shiftrightunsigned(F.xxhash64(F.col(text)), 64 - WORD)})
    again = rows.groupBy("_loom_h1", "_loom_h2").agg(F.count("*").alias("n")).where("n > 1").select("_loom_h1", "_loom_h2")
    again = materialize(again, "again", few_files=True)
    n = again.count()
    if not n:
        return rows
    again = small(again, n)
    placed = materialize(rows.join(again, ["_loom_h1", "_loom_h2"], "left_semi").withColumn("_loom_place", F.monotonically_increasing_id()), "placed")
    told = F.shiftrightunsigned(F.xxhash64("_loom_h2", "_loom_place"), 64 - WORD)
    return rows.join(again, ["_loom_h1", "_loom_h2"], "left_anti").select(*rows.columns).unionByName(placed.withColumn("_loom_h2", told).select(*rows.columns))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table of longs: (node, root) with root the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each of which
    only shuffles edges by node; a node's neighbours are never gathered, only their minimum.
    Each round is written to the shared folder, and the loop ends when a round changes nothing.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialize(pairs, "cc")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not mark[0]:
            break
        then = materialize(_star_round(now), "cc")
        changed = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now, same = then, changed == mark
        mark = changed
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _star_round(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step on distinct pairs u > v."""
    # large star: every larger neighbour of u, to the smallest of u and its neighbours
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small star: u and its smaller neighbours, to the smallest of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small_star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return small_star.where("u <> v").distinct()
