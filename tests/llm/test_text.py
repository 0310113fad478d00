"""Language ID, decontamination and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, langid

from ..conftest import SMALL
from .conftest import DOCUMENTS, doc


def test_held_out_accuracy(spark):
    got = langid.op7_language_id(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = spark.createDataFrame([doc(i, f"some words {i}", "en") for i in range(30)], DOCUMENTS)
    lies = rows.withColumn("lang", F.when(langid.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    model = langid.fit(lies)
    assert model.languages == ["en"] and model.predict("anything") == ("en", 1.0)


def test_language_edges(spark, table):
    rows = [doc(1, None), doc(2, "12 %%"), doc(3, ""), doc(None, "the words", "en"), doc(7, "der und die", "de"), doc(8, "the and of", "en"), doc(8, "the and of", "en"), doc(11, "le la les", None), doc(4, "é", "fr")]
    folder = table("documents", rows, DOCUMENTS)
    got = langid.op7_language_id(spark, folder).collect()
    assert len(got) == 9
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3)) and all(r.lang_pred != "und" for r in got if r.doc_id not in (1, 2, 3))
    unlabelled = table("documents", [doc(1, "words", None)], DOCUMENTS)
    assert [(r.lang_pred, r.score) for r in langid.op7_language_id(spark, unlabelled).collect()] == [("und", 0.0)]
    nothing = table("documents", [], DOCUMENTS)
    assert langid.op7_language_id(spark, nothing).count() == 0


def test_very_long_texts_are_read_whole():
    head, tail = "abc " * 300_000, "xyz " * 300_000
    v = langid.vector(head + tail)
    assert np.isclose((v**2).sum(), 1) and abs(float(v @ langid.vector(head)) - float(v @ langid.vector(tail))) < 0.01


def test_svm_separates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(80, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    w = langid.train_svm(x, y, c=100)
    assert ((np.hstack([x, np.ones((80, 1))]) @ w > 0) == (y > 0)).mean() > 0.95


def brute_leaks(docs, items):
    words = lambda t: regex.findall(r"[\p{L}\p{N}\p{M}_]+", (t or "").lower().replace("ς", "σ").replace("i\u0307", "i"))
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in docs:
        for j, b in items:
            w = words(b)
            if w:
                k = min(5, len(w))
                have = len(runs(w, k) & runs(words(t), k))
                if have >= 0.8 * len(runs(w, k)) - 1e-9:
                    out.add((i, j, have, len(runs(w, k))))
    return out


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_containment_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 14, 30, 60])] + [(20, None), (21, "!!"), (22, ""), (23, "éa ß " + some(6)), (24, "हिन्दी में यह एक वाक्य है"), (25, "ΑΣ İx")]
    docs = []
    for i in range(120):
        words = some(draw.randint(0, 60)).split()
        if i % 2:
            inner = (draw.choice(items)[1] or "").split()
            for _ in range(draw.randint(0, 4)):
                if inner:
                    inner[draw.randrange(len(inner))] = "changed"
            words[3:3] = inner
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(503, "और " + items[-2][1] + " है"), (504, "so ας ix")]
    docs += [(500, None), (501, ""), (502, (some(2000) + " " + items[8][1]) * 2)]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    right = spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.leaks(left, right).collect()}
    assert got == want and len({i for i, *_ in want}) > 10
    kept = [r.doc_id for r in decontaminate.without_leaks(left, right).collect()]
    assert sorted(kept) == [i for i, _ in docs if i not in {d for d, *_ in want}]
    assert decontaminate.leaks(left, right.limit(0)).count() == 0 and decontaminate.leaks(left.limit(0), right).count() == 0
    assert decontaminate.without_leaks(left, right.limit(0)).count() == len(docs)


def test_pipeline_stages(spark, table, tmp_path):
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    more = [doc(9001, None), doc(9002, "123"), doc(9003, "so " + item + " and on"), doc(None, "a text without any id here"), doc(None, "a text without any id here")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("shard_id", F.lit("own"))
    for name in ("_id", "_n", "_size", "copies", "t1", "fp", "target", "_lang", "content", "uid", "bytes"):
        docs = docs.withColumn(name, F.lit("extra"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    seen = {}
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if i < 4:
            assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert not seen["language"] & {9001, 9002} and 9003 in seen["language"]
    assert 9003 in seen["near_dedup"] and 9003 not in seen["decontamination"]
    assert None in seen["near_dedup"] and spark.read.parquet(str(tmp_path / "s1")).where("doc_id is null").count() == 1
    assert seen["mixing"] <= seen["decontamination"] and seen["sharding"] == seen["mixing"]
    assert all(now.where(F.col(n) != "extra").count() == 0 for n in ("_id", "_n", "_size", "copies", "t1", "fp", "target", "_lang", "content", "uid", "bytes"))
    assert "shard_bytes" in now.columns and now.where("shard_id = 'own'").count() == 0


def test_pipeline_query(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, SMALL).count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_language_is_learned(spark):
    """70 labels, each with words of its own; the rarest are known as well."""
    name = lambda k: f"x{chr(97 + k // 26)}{chr(97 + k % 26)}"
    rows = [doc(100 * k + i, f"{name(k) * 3} {name(k)} {name(k) * 2} {i}", name(k)) for k in range(70) for i in range(8 if k >= 64 else 12)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    model = langid.fit(df)
    assert model.languages == [name(k) for k in range(70)]
    got = langid.predict(df.where("doc_id >= 6400"), model).collect()
    assert len(got) == 48 and all(r.lang_pred == r.lang for r in got)


def test_a_language_under_one_id_is_learned(spark):
    """A third of the rows under one id that isn't held out, and a label with one row only."""
    key = next(i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 5)
    rows = [doc(key, f"le chat noir {i} et la souris", "fr") for i in range(2000)] + [doc(1000 + i, f"the black cat {i} and a mouse", "en") for i in range(900)]
    rows += [doc(key, "12", "fr")] * 500 + [doc(key, "il gatto nero e il topo", "it")] * 3
    model = langid.fit(spark.createDataFrame(rows, DOCUMENTS))
    assert model.languages == ["en", "fr", "it"]
    assert model.predict("le chat et la souris")[0] == "fr" and model.predict("the cat and the mouse")[0] == "en" and model.predict("½ ²")[0] == "und"


def test_votes_against_brute_force(spark):
    """The two levels of votes, counted one pair at a time from the learned weights."""
    got = langid.op7_language_id(spark, SMALL).select("doc_id", "lang_pred").collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)

    def winner(among, x):
        votes = {a: [0, 0.0] for a in among}
        for (a, b), w in zip(model.pairs, model.weights.T, strict=True):
            if a in votes and b in votes:
                margin = float(x @ w[:-1] + w[-1])
                votes[a if margin > 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        return max(sorted(votes), key=lambda a: tuple(votes[a]))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
        else:
            x = langid.vector(text)
            assert r.lang_pred == winner(model.members[winner(model.families, x)], x)


def test_items_of_many_blocks_with_string_ids_take_two_scans(spark, monkeypatch, tmp_path):
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [doc_id#")
    seen = []

    def spy(df, *more, write=decontaminate.materialize):
        seen.append(scans(df))
        return write(df, *more)

    monkeypatch.setattr(decontaminate, "materialize", spy)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = spark.createDataFrame([(f"i{k}", f"one{k} two{k} three{k} four{k} five{k} six{k}") for k in range(12)] + [(None, "just three words")], "item_id string, text string")
    docs = [(f"d{k}", f"so one{k} two{k} three{k} four{k} five{k} six{k} on") for k in range(20)] + [(None, "these just three words"), ("d0", None), ("x", "two1 one1")]
    spark.createDataFrame(docs * 2, "doc_id string, text string").withColumns({"item": F.lit("own"), "content": F.lit("own"), "doc": F.lit("own")}).write.parquet(str(tmp_path / "loom_docs"))
    df = spark.read.parquet(str(tmp_path / "loom_docs"))
    found = decontaminate.leaks(df, items)
    assert sorted((str(r.doc_id), str(r.item_id), r.n_shared) for r in found.collect()) == sorted([(f"d{k}", f"i{k}", 2) for k in range(12)] + [("None", "None", 1)])
    # however many blocks the items would make, the documents are read once for candidates and once to verify
    assert sum(seen) == 1 and scans(found) <= 2
    assert len(decontaminate.without_leaks(df, items).collect()) == 2 * len(docs) - 2 * 13


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage by plain loops over its predecessor's rows; of sharding the rows and the shards' sizes."""
    import hashlib

    from corpusloom.llm import sharding

    from .test_duplicates import brute_fingerprint, corpus, roots
    from .test_sharding_mixing import brute_targets

    draw = random.Random(9)
    items = [(i, " ".join(f"b{i}x{draw.randint(0, 9)}" for _ in range(12))) for i in range(6)]
    texts = corpus(31)
    texts += [f"{draw.choice(texts) or 'x'} {draw.choice(items)[1]}" for _ in range(8)]
    rows = [doc(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "a", "b", "c", None])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = langid.fit(df)
    now = [r for r in rows if model.predict(r[1])[0] != "und"]
    fp = {r[0]: brute_fingerprint(r[1]) for r in now}
    first = roots(list(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    now = [r for r in now if first[r[0]] == r[0]]
    held = {i for i, *_ in brute_leaks([(r[0], r[1]) for r in now], items)}
    assert held and len(now) < len(rows)
    now = [r for r in now if r[0] not in held]
    size = {r[0]: len(regex.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in now}
    sizes = {}
    for r in now:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want = []
    for source, target in brute_targets(sizes).items():
        whole = int(target // sizes[source])
        need, before = target - whole * sizes[source], 0
        place = lambda r: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16)
        for r in sorted((r for r in now if r[3] == source), key=place):
            n = size[r[0]]
            once = before + n <= need or (before <= need and n < 2 * (need - before))
            want += [r[0]] * (min(3, whole + once) if n else 0)
            before += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    held_bytes, n_rows = {}, {}
    for r in got:
        held_bytes[r.shard_id] = held_bytes.get(r.shard_id, 0) + len(r.text.encode())
        n_rows[r.shard_id] = n_rows.get(r.shard_id, 0) + 1
    assert all((r.shard_bytes, r.shard_rows) == (held_bytes[r.shard_id], n_rows[r.shard_id]) for r in got)
    assert all(n <= sharding.SHARD_BYTES for n in held_bytes.values())
