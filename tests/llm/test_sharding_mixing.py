from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, sharding

from .conftest import DOCUMENTS, doc


def shards(df, limit):
    return [r.asDict() for r in sharding.shard(df, limit).collect()]


def test_shards_fit_and_are_needed(spark):
    draw = random.Random(1)
    df = spark.createDataFrame([doc(i, "x" * draw.randint(0, 300)) for i in range(500)], DOCUMENTS)
    rows = shards(df, 2000)
    assert len(rows) == 500
    size, n = {}, {}
    for r in rows:
        size[r["shard_id"]] = size.get(r["shard_id"], 0) + len(r["text"])
        n[r["shard_id"]] = n.get(r["shard_id"], 0) + 1
    assert all(s <= 2000 for s in size.values())
    assert all((r["shard_bytes"], r["shard_rows"], r["shard_depth"]) == (size[r["shard_id"]], n[r["shard_id"]], len(r["shard_id"])) for r in rows)
    for s in size:  # no shard is split that needn't be: its parent's rows don't fit
        assert s == "" or sum(v for k, v in size.items() if k.startswith(s[:-1])) > 2000
    for a in size:
        assert not any(b != a and b.startswith(a) for b in size)


def test_hot_and_null_keys_are_split(spark):
    rows = [doc(None, f"text {i} " + "y" * 90) for i in range(60)] + [doc(7, "z" * 100)] * 40 + [doc(i, "w" * 100) for i in range(20)]
    got = shards(spark.createDataFrame(rows, DOCUMENTS), 1000)
    size = {}
    for r in got:
        size[r["shard_id"]] = size.get(r["shard_id"], 0) + len(r["text"])
    assert len(got) == 120 and max(size.values()) <= 1000


def test_edges(spark):
    df = spark.createDataFrame([doc(1, None), doc(2, ""), doc(3, "a" * 5000)], DOCUMENTS).withColumn("shard_id", F.lit("mine")).withColumn("_note", F.lit(1))
    got = {r["doc_id"]: r for r in shards(df, 100)}
    assert got[3]["shard_rows"] == 1 and got[3]["shard_bytes"] == 5000 and got[1]["_note"] == 1 and got[1]["shard_id"] != "mine"
    assert shards(df.limit(0), 100) == []
    assert [r["shard_id"] for r in shards(df, 10_000)] == ["", "", ""]


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in names}
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_met(spark, seed):
    draw = random.Random(seed)
    rows = [doc(i, "w " * draw.randint(0, 40), source=draw.choice(["a", "a", "a", "b", "c", "dd", None])) for i in range(400)] + [doc(1000 + i, "w " * 30, source="rare") for i in range(2)]
    got = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, DOCUMENTS)).collect()]
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["_loom_size"]
    want = brute_targets(sizes)
    taken, most = {}, {}
    for r in got:
        assert r["_loom_source_size"] == sizes[r["source"]] and r["_loom_target"] == pytest.approx(want[r["source"]]) and 0 <= r["_loom_copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["_loom_size"] * r["_loom_copies"]
        most[r["source"]] = max(most.get(r["source"], 0), r["_loom_size"])
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in taken)


def test_rows_that_repeat_are_told_apart(spark):
    rows = [doc(None, "a b c d", source="hot")] * 300 + [doc(5, "x y", source="hot")] * 300 + [doc(i, "q r s", source=f"t{i % 4}") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, DOCUMENTS).repartition(5)).groupBy("source").agg(F.sum(F.col("_loom_size") * F.col("_loom_copies")).alias("t"), F.first("_loom_target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 4 for r in got)


def test_mix_edges(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert mixing.mix(empty).count() == 0
    none = mixing.mix(spark.createDataFrame([doc(1, None), doc(2, " \t")], DOCUMENTS)).collect()
    assert [(r._loom_size, r._loom_target, r._loom_copies) for r in none] == [(0, 0.0, 0)] * 2
    one = mixing.mix(spark.createDataFrame([doc(1, "a b")], DOCUMENTS)).collect()
    assert [(r._loom_size, r._loom_target, r._loom_copies) for r in one] == [(2, 2.0, 1)]


def test_a_hot_source_leaves_the_others_boundary_rows(spark, same, table):
    """Sources of a few long documents close at 12 bits, the hot one goes on to 24: the boundary document is taken all the same."""
    rows = [doc(i, "w " * (1 + i % 5), source="hot") for i in range(20_000)]
    rows += [doc(30_000 + 10 * s + i, "w " * (900 + 37 * i + 11 * s), source=f"few{s}") for s in range(12) for i in range(6)]
    folder = table("documents", rows, DOCUMENTS)
    same(mixing.op3_mixing, mixing.OP3_SQL, folder, ["documents"])


@pytest.fixture()
def repeated(spark, tmp_path):
    """60 documents of random text and a wide further column, three times each behind a shuffle join, which AQE cuts otherwise for each set of columns."""
    from pyspark.sql import functions as G

    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    draw = random.Random(4)
    rows = [(i, draw.randbytes(20_000).hex(), "s" if i % 3 else "t", draw.randbytes(1000 * (i % 60)).hex()) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, wide string").repartition(8).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(i, c) for i in range(60) for c in range(3)], "doc_id long, c int").repartition(4).write.parquet(str(tmp_path / "copies"))
    yield spark.read.parquet(str(tmp_path / "docs")).join(spark.read.parquet(str(tmp_path / "copies")), "doc_id").drop("c").withColumn("note", G.lit(1))
    for k, v in was.items():
        spark.conf.set(k, v)


def test_repeated_rows_behind_a_shuffle_fit_their_shards(repeated):
    got = [r.asDict() for r in sharding.shard(repeated, 100_000).select("doc_id", "_loom_bytes", "shard_id", "shard_bytes", "shard_rows").collect()]
    size, n = {}, {}
    for r in got:
        size[r["shard_id"]] = size.get(r["shard_id"], 0) + r["_loom_bytes"]
        n[r["shard_id"]] = n.get(r["shard_id"], 0) + 1
    assert len(got) == 180 and all((r["shard_bytes"], r["shard_rows"]) == (size[r["shard_id"]], n[r["shard_id"]]) for r in got)
    assert all(s <= 100_000 for s in size.values()) and len({r["shard_id"] for r in got if r["doc_id"] == 7}) >= 1


def test_repeated_rows_behind_a_shuffle_are_mixed_alike(repeated):
    words = F.regexp_replace("text", "([0-9a-f]{7})", "$1 ")
    mixed = mixing.mix(repeated.withColumn("text", words))
    sums = lambda: {r.source: (r.t, r.g, r.w) for r in mixed.groupBy("source").agg(F.sum(F.col("_loom_size") * F.col("_loom_copies")).alias("t"), F.first("_loom_target").alias("g"), F.max("_loom_size").alias("w")).collect()}
    rows = lambda: sorted(tuple(r) for r in mixed.groupBy("doc_id").agg(F.sum("_loom_copies"), F.max(F.length("wide"))).collect())
    assert all(abs(t - g) <= w / 2 + 1e-6 for t, g, w in sums().values()) and rows() == rows()


def test_many_sources_are_ranked_by_ranges(spark):
    names = [f"h{i:04d}" for i in range(300)] + [None]
    rows = [doc(3 * i + j, "w " * (1 + i * 37 % 50), source=s) for i, s in enumerate(names) for j in range(3)]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    got = {r.source: r.g for r in mixing.mix(spark.createDataFrame(rows, DOCUMENTS)).groupBy("source").agg(F.first("_loom_target").alias("g")).collect()}
    assert got == pytest.approx(brute_targets(sizes))
