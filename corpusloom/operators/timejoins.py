"""Joins over time: points within spans of their key, and the last earlier row of their key.

Both are equality joins or shuffles by key underneath; no plan has a nested loop, and no hot key has to fit in a task.

within_spans: time is cut into bins as wide as a typical span. A span is cut at the ends of bins, and what lies between is put together to
nodes of FANOUT bins, FANOUT ** 2 bins and so on, so that a span of any length has a few dozen pieces at most. Points are looked up by their bin, and by
the node above it on each level that any span has a piece on. A piece whose node has many points of its key is dealt out: points to one of
several salts by a hash of the row, the piece to all of them.

as_of: rows of both sides are sorted by time within their key. A key with many rows is cut into ranges of time, at quantiles of its own; what the
last row before a range was is carried over by a table with one row for each range. Where one instant holds many rows, the ones that look
back are dealt over all ranges that begin at it, as each of these has the same answer for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

FANOUT = 16
#: Rows of a key, or of a node of it, from which they are dealt to several tasks.
MOST = 1_000_000
#: Most bytes of a join side that may be broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if so many rows of this size are within the bound, else df: a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ticks(df: DataFrame, column: str) -> Column:
    """Timestamps as microseconds, dates as days, whole numbers as they are."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(F.col(column).cast("date")).cast("long") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
        return seconds * 1_000_000 + (F.date_part(F.lit("seconds"), F.col(column)) * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    raise ValueError(f"{column} is neither a time nor a whole number")


def _div(x: Column, width: int) -> Column:
    """x in whole widths, rounded down; longs throughout."""
    w = F.lit(width).cast("long")
    return F.call_function("div", x - F.pmod(x, w), w)


# --- points within spans -----------------------------------------------------------------------------------------


def _levels(longest: int, width: int) -> int:
    """Levels of nodes that spans of this length can have pieces on."""
    bins, n = longest // width + 2, 1
    while bins > 2 * FANOUT:
        bins, n = bins // FANOUT, n + 1
    return n


def pieces(first: Column, last: Column, levels: int) -> Column:
    """The nodes that bins first to last are put together to: an array of (level, node). At most 2 * (FANOUT - 1) of each level but the last."""
    kind = "array<struct<level: int, node: bigint>>"

    def nodes(level: Column, a: Column, b: Column) -> Column:  # a to b - 1
        some = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(some, lambda n: F.struct(level.cast("int").alias("level"), n.alias("node")))

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        up, down = _div(a + (FANOUT - 1), FANOUT), _div(b, FANOUT)
        whole = (up >= down) | (level == levels - 1)
        rest = F.concat(nodes(level, a, up * FANOUT), nodes(level, down * FANOUT, b))
        return F.struct(
            F.when(whole, b).otherwise(up).alias("a"), F.when(whole, b).otherwise(down).alias("b"), F.concat(state["out"], F.when(whole, nodes(level, a, b)).otherwise(rest)).alias("out")
        )

    start = F.struct(first.alias("a"), (last + 1).alias("b"), F.array().cast(kind).alias("out"))
    # when all is put together, a equals b: the levels that remain add nothing
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, lambda state: state["out"])


def within_spans(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int | None = None, most: int = MOST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All pairs of a point and a span of its key with start <= at < end: the points' columns and the spans' without the key.

    `at`, `start` and `end` are all times or all whole numbers. A null in one of these or in the key matches nothing, nor does a span that ends where it begins, or before; rows that repeat
    match as often as they are there. Columns of both sides other than the key need different names. `width` of bins, in microseconds (dates: days),
    is the median length of the spans if not given; it changes no result. Spans are broadcast if all their pieces are within `broadcast_bytes`; points then are not shuffled.
    """
    _no_clash(points, spans, key)
    spread = [c for c in spans.columns if c != key]
    cut = spans.where(F.col(key).isNotNull()).select("*", ticks(spans, start).alias("_from"), ticks(spans, end).alias("_to")).where("_from < _to")
    if width is None:
        width = cut.agg(F.percentile_approx(F.col("_to") - F.col("_from"), 0.5)).first()[0] or 1
    longest = cut.agg(F.max(F.col("_to") - F.col("_from"))).first()[0]
    levels = _levels(longest or 1, width)
    parts = cut.select("*", F.explode(pieces(_div(F.col("_from"), width), _div(F.col("_to") - 1, width), levels)).alias("_n")).select("*", "_n.*").drop("_n")
    parts = written(parts, "spans")
    # one row for each level that is used
    used = sorted((r.level, r.n) for r in parts.groupBy("level").agg(F.count("*").alias("n")).collect())
    if not used:
        return points.select("*", *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in spread]).where("false")
    on = [F.struct(F.lit(level).alias("level"), _div(F.col("_at"), width * FANOUT**level).alias("node")) for level, _ in used]
    looked = points.select("*", ticks(points, at).alias("_at")).where(F.col(key).isNotNull() & F.col("_at").isNotNull())
    looked = looked.select("*", F.explode(F.array(*on)).alias("_n")).select("*", "_n.*").drop("_n")
    n_parts, row_bytes = sum(n for _, n in used), 64 + 32 * len(spans.columns)
    by = [key, "level", "node"]
    if n_parts * row_bytes <= broadcast_bytes:
        joined = looked.join(F.broadcast(parts), by)
    else:
        # nodes of more points than a task should read; at most all rows / most of them
        heavy = looked.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
        heavy = written(heavy.select(*by, F.ceil(F.col("_rows") / most).cast("int").alias("_deal")), "heavy", few_files=True)
        n_heavy = heavy.count()
        if n_heavy:
            heavy, deal = small(heavy, n_heavy, 64), F.coalesce("_deal", F.lit(1))
            plain = [c for c in points.columns if not isinstance(points.schema[c].dataType, T.MapType)]
            salt = F.when(deal > 1, F.pmod(F.xxhash64(*plain), deal)).otherwise(F.lit(0)).cast("int")
            looked = looked.join(heavy, by, "left").withColumn("_salt", salt).drop("_deal")
            parts = parts.join(heavy, by, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), deal - 1))).drop("_deal")
            by = [*by, "_salt"]
        joined = looked.join(parts, by)
    return joined.where("_from <= _at and _at < _to").select(*points.columns, *spread)


def _no_clash(left: DataFrame, right: DataFrame, key: str) -> None:
    both = (set(map(str.lower, left.columns)) & set(map(str.lower, right.columns))) - {key.lower()}
    if both or any(c.startswith("_") for c in (*left.columns, *right.columns)):
        raise ValueError(f"both sides have columns {sorted(both)}, or one begins with an underscore")


# --- the last earlier row ----------------------------------------------------------------------------------------


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, tie: list[str] | None = None, strict: bool = False, most: int = MOST) -> DataFrame:
    """left with the columns of the last row of right (but its key) of the same key at or before left's time; `strict`: before it. Nulls where there is none.

    Of right's rows of one instant the largest by the columns `tie`, then by the others that have an order, counts. Rows of left with a null key or time find nothing and
    stay; such rows of right are not found. Rows of left that repeat stay as often. Columns other than the key need different names.
    """
    _no_clash(left, right, key)
    found = [c for c in right.columns if c != key]
    tie = tie or []
    order = [*tie, *[c for c in found if c not in tie and not isinstance(right.schema[c].dataType, T.MapType)]]
    l_rows = left.select(F.col(key).alias("_key"), ticks(left, at).alias("_at"), F.struct(*left.columns).alias("_l"))
    none = l_rows.where("_key is null or _at is null").select("_l.*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in found])
    l_rows = l_rows.where("_key is not null and _at is not null")
    r_rows = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("_key"), ticks(right, right_at).alias("_at"), F.struct(*found).alias("_r"), F.struct(*order).alias("_o"))
    # one row of right an instant: partial aggregation, before anything is sorted
    r_rows = written(r_rows.groupBy("_key", "_at").agg(F.max_by("_r", "_o").alias("_r")), "right")
    thin = l_rows.select("_key", "_at").unionAll(r_rows.select("_key", "_at"))
    n = thin.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = written(n.withColumn("_ranges", F.ceil(F.col("n") / most).cast("int") + 1), "hot", few_files=True)
    n_hot, ranges = hot.agg(F.count("*"), F.max("_ranges")).first()
    if not n_hot:
        rows = l_rows.select("_key", "_at", F.lit(0).alias("_range"), "_l", F.lit(None).cast(r_rows.schema["_r"].dataType).alias("_r")).unionAll(r_rows.select("_key", "_at", F.lit(0), F.lit(None).cast(l_rows.schema["_l"].dataType), "_r"))
        carried = rows.withColumn("_c", F.lit(None).cast(r_rows.schema["_r"].dataType))
    else:
        # the bounds of a hot key's ranges: quantiles of its own times, as many as the largest key needs
        keys = small(hot.select("_key", "_ranges"), n_hot, 64)
        quantiles = thin.join(keys, "_key", "left_semi").groupBy("_key").agg(F.percentile_approx("_at", [i / (ranges + 1) for i in range(1, ranges + 1)], 10 * (ranges + 1)).alias("_bounds"))
        bounds = written(quantiles, "bounds", few_files=True)
        bounds = small(bounds, n_hot, 64 + 8 * ranges)
        below = F.size(F.filter("_bounds", lambda b: b < F.col("_at")))
        upto = F.size(F.filter("_bounds", lambda b: b <= F.col("_at")))
        l_rows, r_rows = l_rows.join(bounds, "_key", "left"), r_rows.join(bounds, "_key", "left")
        # an instant that is a bound more than once begins several ranges, and every one of them knows what was before or at it
        spread = below + F.pmod(F.xxhash64("_l"), F.greatest(upto - below, F.lit(1))).cast("int")
        l_range = F.when(F.col("_bounds").isNull(), 0).otherwise(below if strict else spread)
        r_range = F.when(F.col("_bounds").isNull(), 0).otherwise(below)
        l_rows, r_rows = l_rows.withColumn("_range", l_range), r_rows.withColumn("_range", r_range)
        lasts = r_rows.where("_bounds is not null").groupBy("_key", "_range").agg(F.max_by("_r", "_at").alias("_r"))
        # a key has `ranges` rows here at most
        earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        every = bounds.select("_key", F.explode(F.sequence(F.lit(0), F.lit(ranges))).alias("_range"))
        carry = every.join(lasts, ["_key", "_range"], "left").select("_key", "_range", F.last("_r", ignorenulls=True).over(earlier).alias("_c"))
        carry = written(carry.where("_c is not null"), "carry", few_files=True)
        carry = small(carry, n_hot * (ranges + 1), 64 + 32 * len(found))
        kinds = (l_rows.schema["_l"].dataType, r_rows.schema["_r"].dataType)
        rows = l_rows.select("_key", "_at", "_range", "_l", F.lit(None).cast(kinds[1]).alias("_r")).unionAll(r_rows.select("_key", "_at", "_range", F.lit(None).cast(kinds[0]), "_r"))
        carried = rows.join(carry, ["_key", "_range"], "left")
    # right's row of an instant comes before left's of the same, or after them
    first = F.col("_l").isNull().cast("int") * (1 if strict else -1)
    before = Window.partitionBy("_key", "_range").orderBy("_at", first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = F.coalesce(F.last("_r", ignorenulls=True).over(before), F.col("_c"))
    out = carried.select("_l", got.alias("_r")).where("_l is not null").select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in found])
    return out.unionAll(none)
