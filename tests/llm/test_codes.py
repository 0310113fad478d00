"""Operators 11 and 12: byte-pair encoding against the library that defines it, vector codes against all distances in plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, queries, vectorcodes

from ..conftest import SMALL
from .conftest import DOCUMENTS, doc


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.Vocabulary(bpe.default_vocabulary()))


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def agrees(coder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    packed = coder.encode(text)
    assert ids_of(packed) == want
    assert coder.decode(packed) == library.decode(want, skip_special_tokens=False)


PIECES = ["'", "s", "t", "re", "ve", "ll", "d", " ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "B", "Σ", "σ", "ς", "́", "e", "̣", "İ", "1", "٣", "½", "!", "-", "é", "漢", "😀", "‍", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "Ᲊ", "Ɤ", "꟎", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20).map("".join) | st.text(max_size=40))
def test_encodes_and_decodes_as_the_library(coder, library, text):
    agrees(coder, library, text)


def test_characters_of_every_class(coder, library):
    points = [*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x11FFF, 5)]
    texts = [f"a{chr(c)}b{chr(c)}" for c in points if not 0xD800 <= c < 0xE000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(coder.encode(text)) == want.ids, hex(ord(text[1]))


def test_very_long_texts_words_and_blocks(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "MEMORY", 20)  # the memory is full again and again
    rnd = random.Random(3)
    text = "".join(rnd.choice(PIECES) for _ in range(20000))
    agrees(coder, library, text)
    agrees(coder, library, "xq" * 40000 + "'s" + "a" * 30000 + " " * 3000 + "é" * 5000)


def test_texts_taken_together_and_alone(coder, library, monkeypatch):
    rnd = random.Random(4)
    texts = [rnd.choice([None, "", "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60)))]) for _ in range(500)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for block in (1, 100, 1 << 20):
        monkeypatch.setattr(bpe, "BLOCK", block)
        assert [ids_of(x) for x in coder.encode_all(texts)] == want


def test_no_token_reaches_across_a_cut(coder):
    """Every cut is between symbols that no token holds side by side, and all else is left together."""
    text = "The zqx's 12 naïve façades, größer: qzjxkv!?"
    raw, starts, ends, last = coder.fragments(coder.normal(text))
    symbols = lambda a, b, end: [*raw[a : b - 1], raw[b - 1] + 256 * end]
    pieces = [symbols(a, b, end) for a, b, end in zip(starts, ends, last)]
    assert all(coder.v.joined[x, y] for p in pieces for x, y in zip(p, p[1:]))
    assert not any(coder.v.joined[p[-1], q[0]] for p, q in zip(pieces, pieces[1:]))
    assert sum(not end for end in last) > 0  # words are cut inside, too
    assert b"".join(raw[a:b] for a, b in zip(starts, ends)).decode() == text.lower().replace(" ", "")


def test_another_vocabulary_is_refused():
    with pytest.raises(ValueError, match="isn't"):
        bpe.Vocabulary(bpe.public_tokenizers.path("byte_bpe_50k.json"))


CASES = [doc(1, None), doc(2, ""), doc(3, "Hello hello"), doc(3, "Hello hello"), doc(None, " \n "), doc(4, "<|endoftext|>x" * 3), doc(5, "ça va? " * 30000)]


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_bpe_query(spark, table, library):
    folder = table("documents", CASES, DOCUMENTS)
    got = sorted(map(tuple, bpe.op11_bpe(spark, folder).collect()), key=repr)
    assert got == sorted(((d[0], *digests(library, d[1])) for d in CASES), key=repr)
    whole = bpe.op11_bpe(spark, SMALL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in whole.collect()} == {i: digests(library, t) for i, t in texts.items()}


def test_bpe_plan_and_columns(spark, table):
    folder = table("documents", [], DOCUMENTS)
    assert bpe.op11_bpe(spark, folder).collect() == []
    rows = spark.createDataFrame([(1, "x", "hello")], "k long, ids string, text string")
    coded = bpe.decode(bpe.encode(rows))
    assert coded.columns == ["k", "ids", "text", "decoded"]
    assert coded.first()["decoded"] == "hello</w>"
    assert bpe.encode(rows, decoded="said").select("ids", "said").collect() == coded.select("ids", "decoded").collect()
    plan = bpe.op11_bpe(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython [") == 1


# --- operator 12 ---


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract with plain integers and all distances."""
    keep = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0]))
    n = len(keep[0][1]) // parts
    books = [[r[1][p * n : (p + 1) * n] for r in keep[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min((far(r[1][p * n : (p + 1) * n], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for r in keep]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[1][p * n : (p + 1) * n] for r, f in zip(keep, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assigned()
    errors = {}
    for r, f in zip(keep, found):
        errors[r[2]] = errors.get(r[2], 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    most = vectorcodes.LONGEST
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), min(sum(d for d, _ in f), most), min(errors[r[2]], most), sha) for r, f in zip(keep, found)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, _salt string, code int, error string"


def vectors(n, rnd, size=16, spread=1.0):
    as_float = lambda x: float(np.float32(x))
    return [(i, [as_float(rnd.gauss(0, spread)) for _ in range(size)], rnd.choice([None, 0, 1, 2])) for i in range(n)]


def run(spark, table, rows):
    folder = table("embeddings", [(*r, "x", 1, "y") for r in rows], VECTORS)
    return sorted(map(tuple, vectorcodes.op12_vector_codes(spark, folder).collect()), key=repr)


def test_codes_equal_all_distances(spark, table):
    rnd = random.Random(5)
    rows = vectors(150, rnd)
    rows += [(200, None, 1), (201, [float("nan")] + [0.0] * 15, 1), (202, [float("inf")] + [0.0] * 15, 1), (203, [None] + [0.0] * 15, 0), (204, [0.0] * 16, None)]
    rows += [(300 + i, rows[7][1], 2) for i in range(40)]  # repeated vectors
    rows += [(400 + i, [float(rnd.randint(-1, 1)) / 4096 for _ in range(16)], 1) for i in range(60)]  # many ties
    assert run(spark, table, rows) == brute(rows)


def test_few_vectors_and_none(spark, table):
    rnd = random.Random(6)
    rows = vectors(5, rnd)
    assert run(spark, table, rows) == brute(rows)
    assert run(spark, table, [(1, None, 1)]) == []


def test_components_of_any_size(spark, table):
    rnd = random.Random(7)
    rows = vectors(40, rnd, spread=1e30) + [(100 + r[0], *r[1:]) for r in vectors(20, rnd)]
    assert run(spark, table, rows) == brute(rows)


def test_other_lengths_stay_without_code(spark, table):
    rnd = random.Random(8)
    rows = vectors(30, rnd)
    odd = [(50, [1.0, 2.0], 1), (51, [], 0)]
    got = run(spark, table, rows + odd)
    assert [r for r in got if r[0] < 50] == brute(rows)
    assert all(r[1] is None and r[2] is None for r in got if r[0] >= 50) and len(got) == 32


def test_sums_by_label_without_a_broadcast(spark, table, monkeypatch):
    rnd = random.Random(9)
    rows = vectors(60, rnd)
    monkeypatch.setattr(vectorcodes, "small", lambda df, n: df)
    assert run(spark, table, rows) == brute(rows)


def test_the_ring_leaves_out_entries_and_none_that_counts():
    rng = np.random.default_rng(1)
    for spread in (1, 3, 100, 5000):
        x = rng.integers(-spread, spread + 1, (4000, 8)) * rng.integers(1, 6, (4000, 1))
        book = rng.integers(-spread, spread + 1, (16, 8)) * rng.integers(1, 6, (16, 1))
        best, least, computed = vectorcodes.nearest(x, book)
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
        assert computed < far.size


def test_limbs():
    for value in (0, 1, -1, 2**30, -(2**30), 2**200 + 12345, -(2**200) - 12345):
        assert sum(limb << (vectorcodes.LIMB * i) for i, limb in enumerate(vectorcodes.limbs(value))) == value


def test_passes_do_not_shuffle_vectors(spark):
    rows = vectorcodes.kept(spark.read.parquet(f"{SMALL}/embeddings.parquet")).select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v"), F.col("label").alias("_label"))
    length, books = vectorcodes.first_books(rows)
    plan = vectorcodes.coded(rows, books, length)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert set(queries.queries()) >= {"op11_bpe", "op12_vector_codes"}
