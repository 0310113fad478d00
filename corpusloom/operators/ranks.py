"""Values over one order of all rows: ranks, tiles, running values and frames, as windows without PARTITION BY have them, but not in one task.

Rows are numbered first (storage.numbered: ranges of the order are dealt to partitions). The order is followed by a hash of the row and by its place, so
that ties are spread, however many. Numbers are cut into blocks of BLOCK rows, of equal size whatever the values are; within a block a window does the work.

What a block has to know of those before it comes of a table with a row a block: totals of blocks are put together to nodes of 2, 4, 8 … blocks, and a block looks
up the nodes that what lies before it is made of, one for each bit of its number. These are equality joins and sums; there is no window over all blocks.
Frames that reach over a block's ends have the rows there copied to the neighbours.

Orders are ascending with nulls first; columns in `descending` are descending with nulls last. Columns that begin with an underscore, or have a name of the result, are an error. Rows that tie in the whole
order get their numbers by the hash, equal rows in any order. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import numbered, written

BLOCK = 1 << 16
#: Blocks of frames have so many rows at least, if BLOCK has.
LEAST_BLOCK = 1 << 12
#: Rows of a task when rows are dealt out, whatever they compress to, and blocks up to which what a block has to know is broadcast.
TASK_ROWS, BROADCAST_BLOCKS = 1 << 19, 1 << 16
RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
#: How partial values are put together; nulls count for nothing.
JOINED = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def _tasks(rows: DataFrame, n: int) -> int:
    """Partitions for n rows. Sorted rows compress so well that partitions of a size in bytes would hold tens of millions."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))


def _dealt(placed: DataFrame) -> tuple[DataFrame, int]:
    """placed by block, in partitions that are not put together again; and the last block."""
    n, last = placed.agg(F.count("*"), F.max("_block")).first()
    return placed.repartition(_tasks(placed, n), "_block"), last or 0


def _of_blocks(table: DataFrame, last: int) -> DataFrame:
    """A table with a row a block as a side of a join by block."""
    return F.broadcast(table) if last < BROADCAST_BLOCKS else table


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def _placed(rows: DataFrame, order: Sequence[str], descending: Sequence[str], block: int, added: Sequence[str] = ()) -> DataFrame:
    """rows with their number `_n` from 0, its block and the order's values; written."""
    names = {c.lower() for c in added}
    clash = [c for c in rows.columns if c.startswith("_") or c.lower() in names]
    if clash:
        raise ValueError(f"columns begin with an underscore, or have a name of the result: {clash}")
    if not order or block < 1 or set(descending) - set(order):
        raise ValueError("an order of at least one column, of which some descend, and blocks of a row or more are needed")
    plain = [f.name for f in rows.schema if not _has_map(f.dataType)]
    keyed = rows.select("*", F.xxhash64(*plain).alias("_h"), F.monotonically_increasing_id().alias("_i"))
    sort = [F.desc_nulls_last(c) if c in descending else F.asc_nulls_first(c) for c in order]
    placed = numbered(keyed, [*sort, F.col("_h"), F.col("_i")], "_n", _tasks(rows, rows.count())).drop("_h", "_i")
    return written(placed.select("*", _div(F.col("_n"), block).alias("_block"), F.struct(*order).alias("_o")), "placed")


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x, F.lit(n).cast("long"))


def _before(totals: DataFrame, kinds: dict[str, str], backward: bool) -> DataFrame:
    """(_block, c_name…): for each block what those before it, or behind it, come to. totals has (_block, name…)."""
    last = totals.agg(F.max("_block")).first()[0] or 0
    levels = max(int(last).bit_length(), 1)
    at = F.lit(last).cast("long") - F.col("_block") if backward else F.col("_block")
    up = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda j: F.struct(j.alias("level"), F.call_function("shiftright", at, j).alias("node")))
    nodes = totals.select(F.explode(up).alias("_u"), *kinds).select("_u.*", *kinds).groupBy("level", "node").agg(*[AGGREGATES[k](name).alias(name) for name, k in kinds.items()])
    # a number's bit at a level stands for the node before the one that it lies in there
    asked = totals.select("_block", F.explode(up).alias("_u")).where("_u.node % 2 = 1").select("_block", F.col("_u.level").alias("level"), (F.col("_u.node") - 1).alias("node"))
    return asked.join(nodes, ["level", "node"]).groupBy("_block").agg(*[AGGREGATES[k](name).alias(f"_c_{name}") for name, k in kinds.items()])


def _scan(placed: DataFrame, values: dict[str, tuple[str, Column]], backward: bool = False, last: int | None = None) -> DataFrame:
    """placed with each value aggregated (sum, min or max) over all rows up to its own, or from its own on. last: the last block, of rows that are dealt out by block already."""
    if last is None:
        placed, last = _dealt(placed)
    kinds = {name: kind for name, (kind, _) in values.items()}
    ready = placed.select("*", *[x.alias(name) for name, (_, x) in values.items()])
    totals = written(ready.groupBy("_block").agg(*[AGGREGATES[k](name).alias(name) for name, k in kinds.items()]), "totals", few_files=True)
    within = Window.partitionBy("_block").orderBy(F.desc("_n") if backward else F.asc("_n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ready.join(_of_blocks(_before(totals, kinds, backward), last), "_block", "left")
    return both.select(*placed.columns, *[JOINED[k](AGGREGATES[k](name).over(within), F.col(f"_c_{name}")).alias(name) for name, k in kinds.items()])


def _ends(placed: DataFrame) -> tuple[DataFrame, int]:
    """placed with `_new` and `_end`: whether a row is the first, and the last, of those that tie with it; dealt out by block. And the last block."""
    edges = placed.groupBy("_block").agg(F.min_by("_o", "_n").alias("_head"), F.max_by("_o", "_n").alias("_tail"))
    edges = written(edges, "edges", few_files=True)
    before = edges.select((F.col("_block") + 1).alias("_block"), F.struct("_tail").alias("_p"))
    behind = edges.select((F.col("_block") - 1).alias("_block"), F.struct("_head").alias("_q"))
    one = Window.partitionBy("_block").orderBy("_n")
    dealt, last = _dealt(placed)
    rows = dealt.join(_of_blocks(before, last), "_block", "left").join(_of_blocks(behind, last), "_block", "left")
    # wrapped, so that a row that isn't there differs from one whose values are null
    previous = F.coalesce(F.lag(F.struct(F.col("_o").alias("_tail"))).over(one), F.col("_p"))
    following = F.coalesce(F.lead(F.struct(F.col("_o").alias("_head"))).over(one), F.col("_q"))
    new = previous.isNull() | ~previous["_tail"].eqNullSafe(F.col("_o"))
    end = following.isNull() | ~following["_head"].eqNullSafe(F.col("_o"))
    return rows.select(*placed.columns, new.alias("_new"), end.alias("_end")), last


def ranked(rows: DataFrame, order: Sequence[str], descending: Sequence[str] = (), tiles: int | None = None, block: int = BLOCK) -> DataFrame:
    """rows with row_number, rank, dense_rank (long), percent_rank, cume_dist (double), and ntile (long) if `tiles` are asked for."""
    placed = _placed(rows, order, descending, block, RANKS)
    total = placed.count()
    ends, last = _ends(placed)
    found = written(_scan(ends, {"_first": ("max", F.when(F.col("_new"), F.col("_n"))), "dense_rank": ("sum", F.col("_new").cast("long"))}, last=last), "forward")
    found = _scan(found, {"_last": ("min", F.when(F.col("_end"), F.col("_n")))}, backward=True)
    n, all_rows = F.col("_n"), F.lit(total).cast("double")
    out = [
        (n + 1).alias("row_number"), (F.col("_first") + 1).alias("rank"), F.col("dense_rank"),
        (F.col("_first") / F.lit(max(total - 1, 1)).cast("double")).alias("percent_rank"), ((F.col("_last") + 1) / all_rows).alias("cume_dist"),
    ]
    if tiles is not None:
        least, larger = divmod(total, tiles)  # so many tiles have a row more
        cut = larger * (least + 1)
        tile = F.when(n < cut, _div(n, least + 1)).otherwise(larger + _div(n - cut, max(least, 1)))
        out.append((tile + 1).alias("ntile"))
    return found.select(*rows.columns, *out)


def running(rows: DataFrame, order: Sequence[str], values: dict[str, tuple[str, str | Column]], descending: Sequence[str] = (), peers: bool = True, block: int = BLOCK) -> DataFrame:
    """rows with running values: name -> (sum, count, min or max; column). Of all rows up to a row; with `peers`, those that tie with it included, else in the order of numbers.

    Sums of whole numbers and decimals are exact; those of doubles depend on the blocks in their last digits.
    """
    placed = _placed(rows, order, descending, block, tuple(values))
    column = lambda x: F.col(x) if isinstance(x, str) else x
    asked = {name: ("sum", column(x).isNotNull().cast("long")) if kind == "count" else (kind, column(x)) for name, (kind, x) in values.items()}
    if not peers:
        return _scan(placed, asked).select(*rows.columns, *asked)
    ends, last = _ends(placed)
    found = written(_scan(ends, asked, last=last), "forward")
    ending = F.when(F.col("_end"), F.struct("_n", *asked))
    return _scan(found.withColumn("_v", ending).drop(*asked), {"_at": ("min", F.col("_v"))}, backward=True).select(*rows.columns, *[F.col(f"_at.{name}").alias(name) for name in asked])


def _with_neighbours(rows: DataFrame, order, descending, before: int, after: int, block: int, added: Sequence[str]) -> DataFrame:
    """Placed rows, each copied to all blocks with rows that look back at it by `before` or ahead by `after`; `_own` marks the one that is its own."""
    if before < 0 or after < 0:
        raise ValueError("a frame reaches back and ahead by no row or more")
    # wide frames cost each row as much, so that smaller blocks, for more tasks, are worth the rows that are in two of them; one is in three at most
    width = max(min(block, max(LEAST_BLOCK, 16 * (before + after))), before + after)
    placed, n = _placed(rows, order, descending, width, added), F.col("_n")
    last = placed.agg(F.max("_block")).first()[0] or 0
    first_block = _div(F.greatest(n - after, F.lit(0)), width)
    last_block = F.least(_div(n + before, width), F.lit(last).cast("long"))
    return placed.select("*", F.explode(F.sequence(first_block, last_block)).alias("_in")).withColumn("_own", F.col("_in") == F.col("_block"))


def moving(rows: DataFrame, order: Sequence[str], values: dict[str, Column], before: int, after: int = 0, descending: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """rows with aggregates (name -> F.sum("x"), F.avg("x"), …) over the `before` rows before to the `after` rows behind each."""
    near = _with_neighbours(rows, order, descending, before, after, block, tuple(values))
    # a number of its own keeps partitions apart that are small in bytes: the work is in the frames
    near = near.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_in")
    frame = Window.partitionBy("_in").orderBy("_n").rowsBetween(-before, after)
    return near.select(*rows.columns, "_own", *[x.over(frame).alias(name) for name, x in values.items()]).where("_own").drop("_own")


def shifted(rows: DataFrame, order: Sequence[str], values: dict[str, tuple[str, int]], descending: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """rows with values of other rows: name -> (column, places): so many places earlier, or later if negative; null where there is no such row."""
    places = [p for _, p in values.values()]
    near = _with_neighbours(rows, order, descending, max(0, *places), max(0, *[-p for p in places]), block, tuple(values))
    one = Window.partitionBy("_in").orderBy("_n")
    return near.select(*rows.columns, "_own", *[F.lag(c, p).over(one).alias(name) for name, (c, p) in values.items()]).where("_own").drop("_own")
