"""SimHash, exact and substring duplicates, against brute force."""

from __future__ import annotations

import dataclasses
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from corpusloom.llm import exactdedup, fmindex, simhash, suffixarray, windows

from .conftest import DOCUMENTS, doc

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def roots(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in items}


def brute_fingerprint(text):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def corpus(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 160))) for _ in range(40)]
    for i in range(60):
        words = draw.choice(texts).split(" ")
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(draw.choice([" ", "\n", " \t"]).join(words))
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    texts += [f"{draw.choice(vocabulary)} {passage} {draw.choice(texts)[:50]}" for _ in range(20)]
    return texts + [None, "", " \n", "one", "One TWO", "ab " * 200, "a" * 500, "The end. " * 40, "x\x0by\x1cz\xa0w"]


def test_simhash_classes(spark, table):
    texts = corpus()
    folder = table("documents", [doc(i, t) for i, t in enumerate(texts)], DOCUMENTS)
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, folder).collect()}
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp and all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == roots(list(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)


@pytest.mark.parametrize(("group", "gather"), [(4096, 200_000), (16, 200_000), (4096, 5)])
def test_simhash_links_of_large_groups(spark, monkeypatch, group, gather):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "GROUP", group)
    draw = random.Random(group)
    values = set()
    for _ in range(6):
        x = draw.getrandbits(64)
        values |= {x} | {x ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for _ in range(40)}
    values = sorted(values)
    rows = sorted((((p << 32) + ((v >> (32 * (p // 32)) & 0xFFFFFFFF) & ~(1 << p % 32))), v) for v in values for p in range(64))
    keys, fps = np.array([k for k, _ in rows]), np.array([v for _, v in rows], np.uint64).view(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 99]), pa.array(fps[i : i + 99])], ["key", "fp"]) for i in range(0, len(rows), 99)]
    found, deferred = [], {}
    for b in simhash._links(iter(batches), gather):
        for kind, a, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if kind:
                deferred.setdefault(a, []).append(c)
            else:
                found.append((a, c))
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert all(near(a, b) for a, b in found)
    for members in deferred.values():
        found += [(a, b) for a in members for b in members if a < b and near(a, b)]
    edges = {frozenset(x & (2**64 - 1) for x in e) for e in found}
    assert roots(values, lambda a, b: frozenset((a, b)) in edges) == roots(values, near)
    assert bool(deferred) == (gather == 5)


def test_simhash_groups_that_are_shuffled_again(spark):
    draw = random.Random(12)
    values = set()
    for _ in range(4):
        x = draw.getrandbits(64)
        values |= {x} | {x ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for _ in range(50)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    for gather in (3, 200_000):
        found = {(r.a, r.b) for r in simhash.links(fps, gather).collect()}
        assert all(near(a, b) for a, b in found)
        assert roots(sorted(map(signed, values)), lambda a, b, found=found: (a, b) in found or (b, a) in found) == roots(sorted(map(signed, values)), near)


def test_simhash_rows_without_ids(spark):
    from pyspark.sql import functions as F

    rows = [doc(None, "a b c d")] * 3 + [doc(4, "e f g h i j")] * 2 + [doc(9, "e f g h i j"), doc(5, None), doc(6, "")]
    df = spark.createDataFrame(rows, DOCUMENTS)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.neighbours(df).collect()) == sorted([("None", "None")] * 3 + [("4", "4")] * 2 + [("9", "4"), ("5", "5"), ("6", "5")])
    kept = simhash.keep_one(df.withColumnRenamed("lang", "fp")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["4", "5", "None"] and kept[0].__fields__ == ["doc_id", "text", "fp", "source", "n_chars"]
    # extra columns with the operator's names, and a text of 400,000 words that repeats but for its last word
    own = df.withColumns({c: F.lit("own") for c in ("content", "best", "root", "component_id", "fingerprint", "node", "n")})
    long = "tell me why " * 133_333
    more = spark.createDataFrame([(20, long + "a"), (21, long + "b"), (22, long + "a")], "doc_id long, text string")
    kept = simhash.keep_one(own.unionByName(more, allowMissingColumns=True)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["20", "4", "5", "None"] and {r.root for r in kept} == {"own", None}
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.neighbours(df.limit(0)).count() == 0


def brute_exact(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = {}
    for i, t in rows:
        same = [(j, u) for j, u in rows if body(u) == body(t)]
        keep = min(same, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        out[i] = (keep, len(same), keep == i, hashlib.sha256(body(t).encode()).hexdigest())
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, table, weak):
    from pyspark.sql import functions as F

    texts = ["a b", "ab", "a\nb ", "b a", None, "", "\x0b\x0c", "é", "é ", "\xa0", "a\x1cb"] + [f"t{i % 7}  " + " " * (i % 3) for i in range(30)]
    rows = list(enumerate(texts))
    folder = table("documents", [doc(i, t) for i, t in rows], DOCUMENTS)
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exactdedup.sha256
    got = exactdedup.dedup(spark, f"{folder}/documents.parquet", digest=digest, maxBytesPerTrigger=1)  # a file at a time
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()} == brute_exact(rows)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, folder = str(tmp_path / "t"), str(tmp_path / "state")
    first, second = [(1, "x y"), (2, "z")], [(3, "x  y"), (0, "z"), (4, "new")]
    for rows in (first, second):
        spark.createDataFrame([doc(i, t) for i, t in rows], DOCUMENTS).coalesce(1).write.mode("append").parquet(path)
        got = exactdedup.dedup(spark, path, folder=folder)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()} == brute_exact(first + second)
    assert exactdedup.groups(spark, folder, "bigint").count() == 3


def test_exact_dedup_edges(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [doc(None, "q"), doc(None, "q"), doc(7, "r"), doc(7, "r"), doc(7, "other"), doc(3, " q")]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(path)
    got = sorted(((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exactdedup.dedup(spark, path).collect()))
    assert got == sorted([("None", "3", 3, False)] * 2 + [("7", "7", 2, True), ("7", "7", 2, False), ("7", "7", 1, True), ("3", "3", 3, True)])
    # columns of the table's own by names that the operator uses, a text of 5 MB, and ids that are strings
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("b", "x " * 2_500_000), ("a", "x" * 2_500_000), ("c", "y")], "doc_id string, text string")
    for name in ("_metadata", "digest", "rank", "place", "n", "first"):
        df = df.withColumn(name, F.struct(F.lit("own").alias("file_path"), F.lit(1).alias("row_index")))
    df.write.parquet(str(tmp_path / "c"))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.dedup(spark, str(tmp_path / "c")).collect()) == [("a", "b", 2, False), ("b", "b", 2, True), ("c", "c", 1, True)]
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "e"))
    assert exactdedup.dedup(spark, str(tmp_path / "e")).count() == 0


def brute_bytes(rows, span=100):
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - span + 1):
            if data[s : s + span] in seen:
                gone[s : s + span] = True
            seen.add(data[s : s + span])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def brute_words(rows, span=35):
    words = {i: (t or "").encode().split() for i, t in rows}
    count = {}
    for w in words.values():
        for s in range(len(w) - span + 1):
            count[tuple(w[s : s + span])] = count.get(tuple(w[s : s + span]), 0) + 1
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - span + 1):
            if count[tuple(w[s : s + span])] > 1:
                gone[s : s + span] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


CASES = [(suffixarray.op6_suffix_array, brute_bytes), (fmindex.op8_fm_index, brute_words)]


@pytest.mark.parametrize(("query", "brute"), CASES)
@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_windows(spark, table, monkeypatch, query, brute, hot):
    module = suffixarray if brute is brute_bytes else fmindex
    monkeypatch.setattr(module, "SHAPE", dataclasses.replace(module.SHAPE, hot=hot))
    rows = list(enumerate(corpus(11)))
    folder = table("documents", [doc(i, t) for i, t in rows], DOCUMENTS, parts=7)
    assert {r.doc_id: tuple(r)[1:] for r in query(spark, folder).collect()} == brute(rows)


@pytest.mark.parametrize(("query", "brute"), CASES)
def test_repeated_windows_of_rows_without_ids(spark, table, query, brute):
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(9, text), (9, "s " + text), (None, text), (None, text), (2, None), (3, "short")]
    folder = table("documents", [doc(i, t) for i, t in rows], DOCUMENTS)
    got = sorted((str(r.doc_id), r[1], r.n_removed) for r in query(spark, folder).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    whole = brute(list(enumerate(t for _, t in order)))
    # which of two rows with one id comes first is by content hash: the sums agree
    assert sum(x[1] for x in got) == sum(v[0] for v in whole.values()) and len(got) == 6
    assert abs(sum(x[2] for x in got) - sum(v[1] for v in whole.values())) <= 2
    empty = spark.createDataFrame([], DOCUMENTS)
    empty.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert query(spark, folder).count() == 0


@pytest.mark.parametrize(("module", "brute"), [(suffixarray, brute_bytes), (fmindex, brute_words)])
def test_repeated_windows_of_string_ids_and_clashing_names(spark, module, brute):
    """Ids as strings, in their order; further columns with the operators' own names; one text of 300,000 words; a third of the rows the same."""
    from pyspark.sql import functions as F

    draw = random.Random(21)
    long = " ".join(draw.choice("abcdefgh") * draw.randint(1, 9) for _ in range(300_000))
    texts = corpus(5)[:60] + [long, "z " + long[1000:3000]]
    rows = [(f"k{i:03d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for name in ("uid", "gram", "start", "length", "spans", "digits", "content", "opened"):
        df = df.withColumn(name, F.lit("own"))
    assert {r.doc_id: tuple(r)[1:] for r in module.digest(df.repartition(5)).collect()} == brute(rows)
    same = spark.createDataFrame([("a", long[:3000])] * 30 + rows[:60], "doc_id string, text string")
    got = module.digest(same.repartition(7)).collect()
    assert len(got) == 90 and sum(r.n_removed == 0 for r in got if r.doc_id == "a") == (1 if module is suffixarray else 0)


def test_blocks_cut_long_texts(monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 500)
    draw = random.Random(2)
    text = bytes(draw.choice(b"abcd") for _ in range(300)) * 5
    shape = suffixarray.SHAPE

    def covered(chunk):
        monkeypatch.setattr(windows, "CHUNK", chunk)
        block = windows.Block(shape)
        block.add(1, suffixarray.tokens(text))
        rows = block.batch(False)
        place, context = rows.column("place").to_numpy(), rows.column("context").to_numpy()
        spans = [(-1 - p, n) for p, n in zip(place.tolist(), context.tolist(), strict=True) if p < 0]
        gone = np.zeros(len(text), bool)
        for s, n in spans:
            gone[s : s + n] = True
        return int(gone.sum())

    # what lies near a cut is left to the comparison of contexts
    assert 1100 <= covered(1 << 20) <= 1200 and 900 <= covered(500) <= 1200


def test_radix_passes():
    data = np.frombuffer(b"".join([b"x" * 120, bytes(range(100)), b"q", bytes(range(100))]) + b"\0" * 8, np.uint8)
    at = np.arange(120 + 100 + 1 + 1)
    alive, classes = suffixarray.equal_windows(data, at, np.zeros(len(at), np.int64))
    by = {}
    for i, c in zip(alive.tolist(), classes.tolist(), strict=True):
        by.setdefault(c, []).append(i)
    assert sorted(by.values()) == [list(range(21)), [120, 221]]


def test_backward_search():
    draw = random.Random(8)
    sequences = [[draw.randint(1, 3) for _ in range(draw.randint(0, 60))] for _ in range(12)]
    text = np.array([x for s in sequences for x in [*s, 0]])
    end = np.flatnonzero(text == 0)
    begin = np.concatenate([[0], end[:-1] + 1])
    index = fmindex.FMIndex(text, 70)
    which, start, length = fmindex.repeated_runs(index, text, begin, end, span=5)
    got = {(i, s + k) for i, s, n in zip(which.tolist(), start.tolist(), length.tolist(), strict=True) for k in range(n - 4)}
    count = {}
    for s in sequences:
        for i in range(len(s) - 4):
            count[tuple(s[i : i + 5])] = count.get(tuple(s[i : i + 5]), 0) + 1
    assert got == {(j, i) for j, s in enumerate(sequences) for i in range(len(s) - 4) if count[tuple(s[i : i + 5])] > 1}
