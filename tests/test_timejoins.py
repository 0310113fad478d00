"""Interval and as-of joins against brute force: spans of all lengths, ties, hot keys, nulls, and what plans may not have."""

from __future__ import annotations

import random
from contextlib import contextmanager
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import timejoins

from .conftest import SMALL

POINTS, SPANS = "k string, id int, t long", "k string, s int, a long, b long"


def points_of(rnd, n, keys="aaab", top=5000):
    rows = [(rnd.choice([*keys, None]), i, rnd.choice([rnd.randint(-top, top), 7, None])) for i in range(n)]
    return rows + rows[:5]  # rows that repeat


def spans_of(rnd, n, keys="aaab", top=5000):
    rows = []
    for i in range(n):
        a = rnd.randint(-top, top)
        rows.append((rnd.choice([*keys, None]), i, rnd.choice([a, a, a, None]), a + rnd.choice([-5, 0, 1, 3, 17, 300, 2 * top])))
    return rows + [("a", n, -(10**6), 10**6), ("a", n + 1, -(2**40), 2**40), ("c", n + 2, 0, 5)] + rows[:3]


def pairs(points, spans):
    return sorted((i, s) for k, i, t in points for q, s, a, b in spans if None not in (k, t, a, b) and k == q and a <= t < b)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("options", [{}, {"width": 1}, {"width": 37}, {"width": 10**6}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "most": 3}], ids=str)
def test_spans_equal_the_inequality_join(spark, options):
    rnd = random.Random(1)
    points, spans = points_of(rnd, 300), spans_of(rnd, 60)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = timejoins.within_spans(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), "k", "t", "a", "b", **options)
        assert got.columns == ["k", "id", "t", "s", "a", "b"]
        assert sorted((r.id, r.s) for r in got.collect()) == pairs(points, spans)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
        assert ("Exchange hashpartitioning" in plan(got)) == (options.get("broadcast_bytes") == 0)  # points stay where they are, else


def test_a_span_is_put_together_of_few_pieces(spark):
    rnd = random.Random(2)
    rows = [(a, a + rnd.choice([0, 1, 15, 16, 40, 255, 257, 5000, 10**6, 10**12])) for a in [rnd.randint(-(10**6), 10**6) for _ in range(200)]]
    df = spark.createDataFrame(rows, "a long, b long")
    levels = timejoins._levels(10**12, 1)
    for r in df.select("a", "b", timejoins.pieces(F.col("a"), F.col("b"), levels).alias("p")).collect():
        covered = sorted((n.node * timejoins.FANOUT**n.level, (n.node + 1) * timejoins.FANOUT**n.level) for n in r.p)
        assert covered[0][0] == r.a and covered[-1][1] == r.b + 1
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))  # without gaps or overlaps
        assert len(covered) <= 2 * timejoins.FANOUT * levels


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_spans_of_times(spark, kind):
    at = (lambda d: date(2024, 1, d)) if kind == "date" else (lambda d: datetime(2024, 1, d, 12, 30, 1, 250000))
    points = spark.createDataFrame([("a", d, at(d)) for d in range(1, 29)], f"k string, id int, t {kind}")
    spans = spark.createDataFrame([("a", 0, at(3), at(5)), ("a", 1, at(1), at(28))], f"k string, s int, a {kind}, b {kind}")
    got = timejoins.within_spans(points, spans, "k", "t", "a", "b")
    assert sorted((r.s, r.id) for r in got.collect()) == [(0, 3), (0, 4)] + [(1, d) for d in range(1, 28)]


def test_empty_sides_and_clashing_names(spark):
    points, spans = spark.createDataFrame([("a", 1, 1)], POINTS), spark.createDataFrame([("a", 1, 0, 9)], SPANS)
    for p, s in ((points.where("false"), spans), (points, spans.where("false")), (points, spans.where("a > 100"))):
        got = timejoins.within_spans(p, s, "k", "t", "a", "b")
        assert got.collect() == [] and got.columns == ["k", "id", "t", "s", "a", "b"]
    with pytest.raises(ValueError, match="both sides"):
        timejoins.within_spans(points, spans.withColumn("id", F.lit(1)), "k", "t", "a", "b")
    with pytest.raises(ValueError, match="neither"):
        timejoins.within_spans(points.withColumn("t", F.lit("x")), spans, "k", "t", "a", "b")


LEFT, RIGHT = "k string, id int, t long", "k string, rid int, u long, note string"


def last_before(left, right, strict=False):
    out = []
    for k, i, t in left:
        fits = [(u, r) for q, r, u, _ in right if None not in (k, t, u) and q == k and (u < t if strict else u <= t)]
        out.append((i, max(fits)[1] if fits else None))
    return sorted(out, key=repr)


def as_of(spark, left, right, **options):
    got = timejoins.as_of(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "u", tie=["rid"], **options)
    assert got.columns == ["k", "id", "t", "rid", "u", "note"]
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    rows = got.collect()
    assert all((r.rid is None) == (r.note is None) for r in rows)
    return sorted(((r.id, r.rid) for r in rows), key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("most", [10**6, 25, 4])
@pytest.mark.parametrize("top", [5000, 12])
def test_as_of_equals_brute_force(spark, strict, most, top):
    rnd = random.Random(top)
    left = points_of(rnd, 300, top=top)
    right = [(rnd.choice(["a", "a", "b", None]), i, rnd.choice([rnd.randint(-top, top), 7, None]), "x") for i in range(150)]
    assert as_of(spark, left, right, strict=strict, most=most) == last_before(left, right, strict)


def test_as_of_of_empty_sides(spark):
    left, right = [("a", 1, 1), (None, 2, 5), ("a", 3, None)], [("a", 1, 0, "x")]
    assert as_of(spark, left, right) == [(1, 1), (2, None), (3, None)]
    assert as_of(spark, left, [("b", 1, 0, "x")]) == [(1, None), (2, None), (3, None)]
    empty = timejoins.as_of(spark.createDataFrame([], LEFT), spark.createDataFrame(right, RIGHT), "k", "t", "u")
    assert empty.collect() == []
    nothing = timejoins.as_of(spark.createDataFrame(left, LEFT), spark.createDataFrame([], RIGHT), "k", "t", "u")
    assert sorted((r.id, r.rid) for r in nothing.collect()) == [(1, None), (2, None), (3, None)]


@pytest.mark.parametrize("one_instant", [False, True])
def test_a_hot_key_is_more_than_one_task(spark, one_instant):
    n = 3000
    left = spark.range(n).select(F.when(F.col("id") < n // 3, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("int").alias("id"), (F.lit(5) if one_instant else F.col("id")).cast("long").alias("t"))
    right = spark.range(10).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("rid"), F.col("id").alias("u"), F.lit("x").alias("note"))
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}):
        rows = timejoins.as_of(left, right, "k", "t", "u", most=100).where("k = 'hot'").withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == n // 3 and all(r.rid == min(r.t, 9) for r in rows)
    tasks = [sum(r.p == p for r in rows) for p in {r.p for r in rows}]
    assert len(tasks) >= 4 and max(tasks) < n // 6


def test_columns_are_pruned(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("u"), F.col("event_id").alias("c"))
    got = timejoins.as_of(events.select("user_id", "event_id", "ts"), clicks, "user_id", "ts", "u")
    assert "props" not in plan(got)
