"""Operator 3, mixing sources to target weights by hash-threshold histograms.

Every source has a target number of words. A source whose target is r times its size takes each
document floor(r) times, and once more those below a threshold of the row hash. The threshold is
found by histograms: words by source and the first 12 bits of the hash give the bucket in which
the budget ends; only that bucket is cut again by the next 12 bits, until it holds one row. Larger
budgets have larger thresholds, so their choices are nested. No rows are sorted.

Defined cases: null and empty texts have size 0, very long ones are counted whole; null source is a source, last in order; rows with
equal ids are told apart by content, then by a place that is written once (`common.identified`); an empty table gives an empty result; of a
table without words nothing is taken; extra columns are kept (names that begin with _loom_ are the operators' own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WORD_PATTERN, identified, materialize, n_words, numbered, small

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a source or document is taken.
MOST = 3
#: Bits of the hash by which a round's histogram cuts; 4096 cells for each source.
STEP = 12


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return identified(df, key, text).withColumns({"_loom_size": n_words(text), "_loom_source": F.col(source)})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_loom_source, source_size, target) from (_loom_source, _loom_size): each the smaller of a common level times its weight and most times its size.

    The level is found by rounds of sums over the sources, each of which sets aside those that the last level would overfill: the level
    only rises, and stays when no further one is overfilled. Neither that nor the weights' order gathers the sources in a task.
    """
    by = numbered(sizes.groupBy("_loom_source").agg(F.sum("_loom_size").alias("source_size")), [F.col("_loom_source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    by = materialize(by.select("_loom_source", "source_size", weight.alias("weight")), "weights")
    cap = (most * F.col("source_size")).cast("double")
    total, level, aside = by.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        full, n, rest = by.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.count_if(over), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == aside or not rest:
            break
        level, aside = (total - most * full) / rest, n
    return by.select("_loom_source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _ends(depth: int, need: Column, cell: Column, p1: Column, p2: Column) -> tuple[Column, Column]:
    """The thresholds if a source's boundary cell is (p1, p2) at that depth; the cell is taken if that comes closer."""
    left1, left2 = WORD - min(depth, WORD), WORD - max(depth - WORD, 0)
    more = (need * 2 > cell).cast("long")
    if depth <= WORD:
        return (p1 + more) * (1 << left1), F.lit(0).cast("long")
    return p1, (p2 + more) * (1 << left2)


def thresholds(thin: DataFrame, goal: DataFrame) -> tuple[DataFrame, int]:
    """(_loom_source, source_size, target, copies, t1, t2): rows with (_loom_h1, _loom_h2) < (t1, t2) are taken once more. Also the number of sources."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goal.withColumn("copies", whole).withColumns(
        {"need": F.col("target") - F.col("copies") * F.col("source_size"), "p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long"), "cell": F.col("source_size"), "open": F.lit(True)}
    )
    # with no bits used, the cell is the whole source
    state = materialize(state.withColumns(dict(zip(("t1", "t2"), _ends(0, *map(F.col, ("need", "cell", "p1", "p2"))), strict=True))), "mix")
    n = state.count()
    depth = 0
    while depth < 2 * WORD and not state.where("open").isEmpty():
        first = depth < WORD
        word, into = ("_loom_h1", depth) if first else ("_loom_h2", depth - WORD)
        bucket = F.shiftright(word, WORD - into - STEP).bitwiseAND(F.lit((1 << STEP) - 1))
        near = state.where("open").select(F.col("_loom_source").alias("_s"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"))
        inside = F.col("_loom_source").eqNullSafe(F.col("_s")) & (F.shiftright("_loom_h1", WORD - min(depth, WORD)) == F.col("_p1")) & (F.shiftright("_loom_h2", WORD - max(depth - WORD, 0)) == F.col("_p2"))
        hist = thin.join(small(near, n), inside).where("_loom_size > 0").groupBy("_s", bucket.alias("bucket")).agg(F.sum("_loom_size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("_s").orderBy("bucket"))
        hist = hist.withColumn("before", upto - F.col("words"))
        cut = state.where("open").join(hist, F.col("_loom_source").eqNullSafe(F.col("_s")), "left").where("before is null or (before <= need and need < before + words)")
        p1 = F.col("p1") * (1 << STEP) + F.col("bucket") if first else F.col("p1")
        p2 = F.col("p2") if first else F.col("p2") * (1 << STEP) + F.col("bucket")
        cut = cut.select("_loom_source", F.col("need") - F.col("before"), p1, p2, F.col("words"), F.col("n") > 1).toDF("_loom_source", "need", "p1", "p2", "cell", "open")
        # a source that isn't in `cut` takes all or nothing of its rows, or has no words
        cut = cut.select(F.col("_loom_source").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("need", "p1", "p2", "cell", "open")])
        moved = state.join(small(cut, n), F.col("_loom_source").eqNullSafe(F.col("_s")), "left")
        was = F.col("open")
        depth += STEP
        # a source that closes keeps the thresholds of its own depth, however deep others go
        t1, t2 = _ends(depth, *map(F.col, ("_need", "_cell", "_p1", "_p2")))
        now = was & F.col("_cell").isNotNull()
        state = materialize(
            moved.select(
                "_loom_source", "source_size", "target", "copies",
                *[F.when(now, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("need", "p1", "p2", "cell")],
                F.when(now, t1).otherwise(F.col("t1")).alias("t1"),
                F.when(now, t2).otherwise(F.col("t2")).alias("t2"),
                F.coalesce(was & F.col("_open"), F.lit(False)).alias("open"),
            ),
            "mix",
        )
    return state.select("_loom_source", "source_size", "target", "copies", "t1", "t2"), n


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df with _loom_size, _loom_source_size, _loom_target, and _loom_copies: how often the mix takes the row."""
    rows = sized(df, key, text, source)
    thin = materialize(rows.select("_loom_source", "_loom_size", "_loom_h1", "_loom_h2"), "sizes", few_files=True)
    goal, n = thresholds(thin, targets(thin))
    goal = goal.toDF("_loom_s", "_loom_source_size", "_loom_target", "_loom_whole", "_loom_t1", "_loom_t2")
    out = rows.join(small(goal, n, 128), F.col("_loom_source").eqNullSafe(F.col("_loom_s")))
    below = (F.col("_loom_h1") < F.col("_loom_t1")) | ((F.col("_loom_h1") == F.col("_loom_t1")) & (F.col("_loom_h2") < F.col("_loom_t2")))
    out = out.withColumn("_loom_copies", F.when(F.col("_loom_size") > 0, F.least(F.col("_loom_whole") + below.cast("long"), F.lit(MOST))).otherwise(F.lit(0).cast("long")))
    return out.drop("_loom_s", "_loom_source", "_loom_h1", "_loom_h2", "_loom_whole", "_loom_t1", "_loom_t2")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("_loom_size").alias("size"), F.col("_loom_source_size").alias("source_size"), F.col("_loom_target").alias("target"), (F.col("_loom_size") * F.col("_loom_copies")).alias("taken"))


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, SUM(source_size) OVER ()::BIGINT AS total,
             (SUM(source_size) OVER q - source_size)::BIGINT AS low,
             (SUM(weight) OVER () - SUM(weight) OVER q + weight)::BIGINT AS rest
      FROM w WINDOW q AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min_by(lv, source_size / weight) AS lv FROM (SELECT *, CAST(total - 3 * low AS DOUBLE) / rest AS lv FROM o) WHERE 3 * source_size >= lv * weight),
t AS (SELECT w.source, w.source_size, LEAST(CAST(3 * source_size AS DOUBLE), l.lv * weight) AS target FROM w, l),
u AS (SELECT *, floor(target / source_size) AS copies, target - floor(target / source_size) * source_size AS need FROM t),
r AS (SELECT d.*, u.source_size, u.target, u.copies, u.need,
             SUM(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       (size * LEAST(3, copies + CASE WHEN before + size <= need OR (before <= need AND size < 2 * (need - before)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
