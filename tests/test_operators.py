from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunk, crawl, evaluate, generate, index, merge, neardup
from corpusloom.sources.fetch import Archive


def words(n, first=0):
    return " ".join(f"w{i}" for i in range(first, first + n))


@pytest.mark.parametrize(("n", "want"), [(29, [29]), (400, [400]), (401, [400, 51]), (720, [400, 370]), (740, [400, 390, 40])])
def test_windows(spark, n, want):
    docs = spark.createDataFrame([(1, "u", "t", words(n))], "doc_id long, url string, title string, text string")
    rows = chunk.chunks(docs).orderBy("part_idx").collect()
    assert [len(r.text.split("\n", 1)[1].split()) for r in rows] == want
    assert [r.section for r in rows] == ([""] if n <= 400 else [f"part {i + 1}" for i in range(len(want))])


def test_window_steps(spark):
    w = spark.range(1).select(chunk.windows(F.array(*[F.lit(str(i)) for i in range(33)]), 31, 31)).first()[0]
    assert [x[0] for x in w] == ["0", "1", "2", "3"]
    with pytest.raises(ValueError):
        chunk.check_sizes(29, 0)


def test_sections(spark):
    text = F.lit("intro\n\n## A\n## B\nx\n### no heading\n## C\n  \n##  D  \ny")
    got = spark.range(1).select(chunk.sections(text)).first()[0]
    assert [(s.heading, s.text) for s in got] == [("", "intro"), ("B", "x\n### no heading"), ("D", "y")]


def test_chunk_labels_and_lengths(spark):
    one = "## Only\n" + words(20)
    two = f"## First\n{words(450)}\n## Second\n{words(5)}"
    docs = spark.createDataFrame([(1, "u", None, one), (2, "u", "T", two), (3, "u", "T", "s" * 49), (4, "u", "T", "s" * 50)], "doc_id long, url string, title string, text string")
    rows = {(r.doc_id, r.section_idx, r.part_idx): r for r in chunk.chunks(docs).collect()}
    assert rows[1, 0, 0].text == "\n" + one and rows[1, 0, 0].section == ""
    assert rows[2, 0, 1].text.startswith("T > First (part 2)\n") and rows[2, 0, 1].section == "First (part 2)"
    assert rows[2, 1, 0].text == f"T > Second\n{words(5)}"
    assert {k[0] for k in rows} == {1, 2, 4}


def brute_bm25(questions, docs, k):
    import re

    split = lambda t: re.findall("[a-z0-9_]+", t.lower())
    body = {i: split(t) for i, t in docs}
    n, mean = len(body), sum(map(len, body.values())) / len(body)
    df = {}
    for b in body.values():
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in questions:
        if not split(text):
            continue
        score = {i: round(sum((raw[t] if raw[t] >= 0 else low) * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / mean)) for t in split(text) if t in raw), 6) for i, b in body.items()}
        out[q] = [(i, pytest.approx(score[i], abs=2e-6)) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]
    return out


@pytest.mark.parametrize("size", [3, 12, 60])
def test_bm25_against_brute_force(spark, size, tmp_path):
    draw = random.Random(size)
    docs = [(i, " ".join(draw.choice("the a cat dog fish bird tree sun moon".split()) for _ in range(draw.randint(0, 12)))) for i in range(size)]
    questions = [(0, "the cat the cat"), (1, "unheard of"), (2, "!?"), (3, "Fish, moon & sun"), (4, "a")]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string")
    asked = spark.createDataFrame(questions, "q long, question string")
    index.write_index(chunks, str(tmp_path / "index"))
    for of in (None, index.read_index(spark, str(tmp_path / "index"))):
        rows = index.top_k(asked, chunks, 5, of).orderBy("q", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r.q, []).append((r.chunk_id, r.score))
        assert got == brute_bm25(questions, docs, 5)


def test_greedy_neardup_against_brute_force(spark):
    draw = random.Random(4)
    texts = ["", "!!"] + [" ".join(draw.sample("a b c d e f g h".split(), draw.randint(1, 6))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, question string")
    kept = []
    for i, t in enumerate(texts):
        w = {x for x in t.replace("!", " ").split()}
        if not w or all(not v or len(w & v) / min(len(w), len(v)) <= 0.8 for _, v in kept):
            kept.append((i, w))
    assert [r.ord for r in neardup.kept(rows).orderBy("ord").collect()] == [i for i, _ in kept]
    # a chain, each like the one before only, takes a round for every other row
    chain = [" ".join(f"w{6 * i + j}" for j in range(-5, 30)) for i in range(12)]
    got = neardup.kept(spark.createDataFrame(list(enumerate(chain)), "ord long, question string"), threshold=0.8).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(0, 12, 2))


def test_merging(spark):
    first = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("x", 3, "c")], "key string, ord long, text string")
    second = spark.createDataFrame([("k", 1, "no"), ("y", 5, "first"), ("y", 6, "second")], "key string, ord long, text string")
    got = {r.key: r.text for r in merge.by_priority(first, second, "key").collect()}
    assert got == {"k": "b", "x": "c", "y": "first"}
    assert {r.key: r.text for r in merge.first_wins(first, "key").collect()}["k"] == "a"
    assert [r.key for r in merge.pending(second, first, "key").collect()] == ["y", "y"]
    assert [r.ord for r in merge.finished(second, first, "key").orderBy("ord").collect()] == [1, 2]
    docs = spark.createDataFrame([("k", "old"), ("n", "old")], "key string, text string")
    assert sorted(tuple(r) for r in merge.assembled(docs, merge.last_wins(first, "key"), "key").collect()) == [("k", "b"), ("n", "old")]


def test_missing_urls(spark):
    corpus = spark.createDataFrame([("http://h/u/",), ("http://h/v?x=1",)], "url string")
    asked = spark.createDataFrame([("http://H/u?x=1",), ("http://h/v?x=1#f",), ("http://h/v?x=2",), ("http://h/w",)], "url string")
    assert sorted(r.url for r in merge.missing(asked, corpus).collect()) == ["http://h/v?x=2", "http://h/w"]


SITE = {
    "http://s.org": '<a href="/a">a</a><a href="/x.pdf">x</a><a href="http://other.org/">o</a>',
    "http://s.org/a": '<a href="/b#f">b</a><a href="/c/">c</a><a href="/lost">l</a>',
    "http://s.org/b": '<a href="/">home</a>',
    "http://s.org/c": "",
}


def test_crawl(spark):
    got = crawl.crawl(spark, ["HTTP://S.org"], SITE.get, "s.org")
    assert {r.url for r in got.collect()} == {"http://s.org", "http://s.org/a", "http://s.org/b", "http://s.org/c"}
    part = crawl.crawl(spark, ["http://s.org"], SITE.get, "s.org", budget=2)
    assert part.count() == 2
    on = crawl.crawl(spark, ["http://s.org"], SITE.get, "s.org", stored=part)
    assert {r.url for r in on.collect()} >= {"http://s.org/b", "http://s.org/c"}


def test_crawl_takes_pages_in_the_order_of_a_queue(spark):
    site = {f"http://s.org/{a}": "".join(f'<a href="/{b}">x</a>' for b in links) for a, links in {"r": "zya", "z": "ba", "y": "cd", "a": "", "b": "", "c": "e", "d": "", "e": ""}.items()}

    def queue(budget):
        out, todo = [], ["r"]
        seen = {"r"}
        while todo and len(out) < budget:
            a = todo.pop(0)
            out.append(f"http://s.org/{a}")
            for b in {"r": "zya", "z": "ba", "y": "cd", "c": "e"}.get(a, ""):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return set(out)

    for budget in (1, 3, 5, 6, 9):
        assert {r.url for r in crawl.crawl(spark, ["http://s.org/r"], site.get, "s.org", budget).collect()} == queue(budget)
        cats = spark.createDataFrame([("x", ["http://s.org/r/"], budget)], "category string, seeds array<string>, cap int")
        assert {r.url for r in crawl.crawl_categories(spark, cats, site.get, "s.org").collect()} == queue(budget)


def test_crawl_of_an_archive_takes_a_level_at_once(spark):
    site = {a: "".join(f'<a href="/{b}">x</a>' for b in links) for a, links in {"r": "0zya", "z": "1ba", "y": "2ncd", "a": "", "b": "r", "c": "e", "d": "", "e": ""}.items()} | {"n": None}
    rows = spark.createDataFrame([(f"http://s.org/{a}", html) for a, html in site.items()], "url string, html string")
    order = [f"http://s.org/{a}" for a in "rzyabcde"]
    for budget in (1, 3, 4, 8, 20):
        passes = []
        got = crawl.crawl(spark, ["http://s.org/r"], Archive(rows), "s.org", budget, batch=1, each=passes.append)
        assert sorted(r.url for r in got.collect()) == sorted(order[:budget])
        assert len(passes) == {1: 1, 3: 2, 4: 2}.get(budget, 4)
    part = crawl.crawl(spark, ["http://s.org/r"], Archive(rows), "s.org", 3)
    on = crawl.crawl(spark, ["http://s.org/r"], Archive(rows), "s.org", 20, stored=part)
    assert sorted(r.url for r in on.collect()) == sorted(order)


def test_crawl_by_category(spark):
    cats = spark.createDataFrame([("x", ["http://s.org"], 3), ("y", ["http://s.org/b", "http://s.org/lost"], None)], "category string, seeds array<string>, cap int")
    got = crawl.crawl_categories(spark, cats, SITE.get, "s.org").groupBy("category").count().collect()
    assert {r.category: r["count"] for r in got} == {"x": 3, "y": 4}


def test_reach(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "src int, dst int")
    got = crawl.reach(edges, spark.createDataFrame([(0,)], "node int"), 3)
    assert sorted((r.node, r.depth) for r in got.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_answers(spark):
    rows = spark.createDataFrame([(0, "q", "p"), (1, " \t", "p"), (2, "q", "boom")], "q long, question string, prompt string")

    def model(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return "Answer: 'yes'\n"

    got = {r.q: (r.prediction, r.error) for r in generate.answers(rows, model).collect()}
    assert got == {0: ("yes", None), 1: ("unknown", None), 2: ("unknown", "RuntimeError: down")}


def test_rewriting(spark):
    docs = spark.createDataFrame([("a", "t", "s" * 49), ("b", None, "s" * 50), ("c", "t", "l" * 60), ("d", "t", "m" * 60)], "url string, title string, text string")

    def model(prompt):
        if "sss" in prompt:
            return "r" * 30
        if "mmm" in prompt:
            raise ValueError
        return "r" * 31

    got = {r.url: (r.llm_cleaned, r.text[0], r.text_original) for r in generate.rewritten(docs, model).collect()}
    assert got == {"a": (False, "s", None), "b": (False, "s", None), "c": (True, "r", "l" * 60), "d": (False, "m", None)}


def test_retries():
    waits, calls = [], []

    def failing(message, n):
        def run(prompt):
            calls.append(message)
            if len(calls) <= n:
                raise RuntimeError(message)
            return " ok "

        return run

    run = generate.with_retries([failing("429", 2)], 5, generate.Rule(generate.asked_or(lambda m: None, lambda n: 15 * (n + 1))), generate.Rule(lambda n, m: 3, 5), None, waits.append)
    assert run("p") == "ok" and waits == [15, 30]
    calls.clear(), waits.clear()
    run = generate.with_retries([failing("x", 99), failing("y", 3)], 6, generate.Rule(lambda n, m: 60), generate.Rule(lambda n, m: 5 * (n + 1), 3), "", waits.append)
    assert run("p") == "ok" and waits == [5, 10]
    waits.clear()
    run = generate.with_retries([failing("RESOURCE_EXHAUSTED, wait 7", 99)], 3, generate.Rule(generate.asked_or(lambda m: 7.0, lambda n: 60)), generate.Rule(lambda n, m: 5, 3), None, waits.append)
    assert run("p") is None and waits == [7.0, 7.0, 7.0]


def test_generated_pairs(spark):
    raw = '```json\n {"question": "q", "answer": "a|b", "url": "x"}\n{"question": 1}\n{bad\nplain\n{"question": "r", "answer": ""}\n```'
    pairs = generate.parsed_pairs(spark.createDataFrame([("u", raw)], "url string, raw string"))
    assert [(r.url, r.question, r.answer) for r in pairs.orderBy("line_no").collect()] == [("u", "q", "a|b"), ("u", "r", "")]
    texts = spark.createDataFrame([("u", "only b here")], "url string, text string")
    assert [r.question for r in generate.validated(pairs, texts).collect()] == ["q"]


def test_prompt(spark):
    ranked = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "q long, rank int, chunk_id long")
    chunks = spark.createDataFrame([(7, "u7", "seven"), (8, None, None)], "chunk_id long, url string, text string")
    asked = spark.createDataFrame([(1, "why"), (2, "")], "q long, question string")
    got = {r.q: r.prompt for r in generate.prompts(ranked, chunks, asked).collect()}
    assert got[1] == "Context:\n[1] u7\nseven\n\n[2] \n\n\nQuestion: why\nAnswer:"
    assert got[2] == "Context:\n\n\nQuestion: \nAnswer:"


def test_recall_needs_an_answer(spark):
    ranked = spark.createDataFrame([(1, 1, 7)], "q long, rank int, chunk_id long")
    chunks = spark.createDataFrame([(7, "The Answer, here")], "chunk_id long, text string")
    gold = spark.createDataFrame([(1, ["", "answer here"]), (2, ["x"]), (3, [""])], "q long, answers array<string>")
    assert {r.q: r.hit for r in evaluate.hits(ranked, chunks, gold).collect()} == {1: True, 2: False, 3: False}


def test_sampling_is_stable(spark):
    rows = spark.range(2000)
    one = [r.id for r in generate.sampled(rows, "id", 0.3, 5).orderBy("id").collect()]
    assert one == [r.id for r in generate.sampled(rows.repartition(7), "id", 0.3, 5).orderBy("id").collect()] and 450 < len(one) < 750
    assert sorted(r.id for r in generate.shuffled(rows, "id").collect()) == list(range(2000))


def test_let_computes_once(spark):
    assert spark.range(1).select(T.let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_pairs_of_all_titles_against_brute_force(spark, tmp_path):
    from itertools import combinations

    from corpusloom.plans import catalogue

    titles = ["What is the café menu today?", "what is the CAFÉ menu today", "Der Fluß und die Stadt", "der fluß und die stadt heute", "plain words only here", "Plain words only here!", "été", "", "naïve plan", "nothing like it"]
    spark.createDataFrame([(i, f"http://h/{i}", f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sets = []
    for t in titles:
        (r,) = spark.createDataFrame([(t,)], "t string").select(T.words(T.question_form(F.col("t"))).alias("w")).collect()
        sets.append(set(r.w))
    want = sorted((a, b) for a, b in combinations(range(len(titles)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) > 0.8)
    got = sorted((r.ord_a, r.ord_b) for r in neardup.pairs(catalogue._titles(spark, str(tmp_path))).collect())
    assert got == want and {(0, 1), (2, 3), (4, 5)} <= set(got)
    # the query gives the same by classes: no link is lost, and none is expanded
    rows = {r.page_id: (r.class_page, r.links) for r in catalogue.neardup_pairs(spark, str(tmp_path)).collect()}
    assert rows == {i: (next(j for j in range(i + 1) if i == j or (sets[i] and sets[j] == sets[i])), sum(i in pair for pair in want)) for i in range(len(titles))}


def test_tables_need_a_shared_folder_off_one_machine():
    from types import SimpleNamespace

    from corpusloom import storage

    session = lambda master, path: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": path} if path else {}))
    assert storage.shared_dir(session("spark://x:7077", "hdfs://a/b/")) == "hdfs://a/b"
    assert storage.shared_dir(session("local[4]", None)).startswith("file:///")
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master, None))


def test_questions_short_of_matches_are_padded_by_the_smallest_ids(spark):
    chunks = spark.createDataFrame([(i, "common words here" if i % 2 else f"rare{i} common") for i in range(12)], "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "rare4"), (2, "nothing known"), (3, "!!"), (4, "rare2 rare8 rare10")], "q long, question string")
    got = {}
    for r in index.top_k(questions, chunks, 4).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.chunk_id)
    assert got == {1: [4, 0, 1, 2], 2: [0, 1, 2, 3], 4: [2, 8, 10, 0]}


def test_links_of_classes_are_those_of_all_pairs(spark):
    texts = ["what is a loom", "is a loom what", "What is a loom?", "what is a big loom", "who knows", "", "?!", None, "who knows", "what is a very big red loom"]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, question string")
    degree = {i: 0 for i in range(len(texts))}
    for p in neardup.pairs(rows).collect():
        degree[p.ord_a] += 1
        degree[p.ord_b] += 1
    got = {r.ord: (r.class_id, r.links) for r in neardup.links(rows).collect()}
    assert {i: n for i, (_, n) in got.items()} == degree
    assert [got[i][0] for i in range(len(texts))] == [0, 0, 0, 3, 4, 5, 6, 7, 4, 9]


def test_overlap_of_long_bags_is_one_pass(spark):
    """Two texts of 30,000 words: a count of every word in both bags would be a thousand million comparisons."""
    from corpusloom.functions.text import bag_overlap

    n = 30000
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i % 20000).cast("string")).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i % 15001 + 5).cast("string")).alias("b"))
    from collections import Counter

    a, b = Counter(i % 20000 for i in range(1, n + 1)), Counter(i % 15001 + 5 for i in range(1, n + 1))
    assert row.select(bag_overlap(F.col("a"), F.col("b"))).first()[0] == sum((a & b).values())
    few = spark.createDataFrame([(["x", "y", "x"], ["x", "x", "z"]), ([], ["x"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in few.select(bag_overlap(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


def test_near_duplicates_broadcast_nothing(spark, tmp_path):
    """Written word sets are small on disk and large in memory: a broadcast of them is held by the driver."""
    rows = spark.range(20).select(F.struct("id", F.lit(1).alias("turn")).alias("ord"), F.concat(F.lit("one two three four five six "), (F.col("id") % 3).cast("string")).alias("question"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for found in (neardup.pairs(rows), neardup.links(rows), neardup.kept(rows)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.links for r in neardup.links(rows).collect()} == {19}
    assert [r.ord.id for r in neardup.kept(rows).collect()] == [0]


def shuffled_records(spark) -> dict[int, int]:
    """Rows that stages up to now wrote for shuffles, by the stage; the oldest stages may be gone."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, jvm = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_candidates_that_share_little_are_not_shuffled(spark, tmp_path):
    """Most of all pairs meet at a word here, and one pair is alike."""
    draw = random.Random(7)
    texts = [" ".join(draw.sample([f"w{i}" for i in range(60)], 12)) for _ in range(600)]
    texts.append(" ".join([*texts[5].split()[:10], "other", "words"]))
    spark.createDataFrame(list(enumerate(texts)), "ord long, question string").write.parquet(str(tmp_path / "rows"))
    last = max(shuffled_records(spark), default=-1)
    found = neardup.pairs(spark.read.parquet(str(tmp_path / "rows"))).collect()
    assert [(p.ord_a, p.ord_b, round(p.ratio, 6)) for p in found] == [(5, 600, 0.833333)]
    # each word of each text twice, a quarter of them as probes, and a few rows for each text
    assert 0 < sum(n for stage, n in shuffled_records(spark).items() if stage > last) < 4 * len(texts) * 12


def test_signatures_never_lose_words(spark):
    """What is set in one set's signature and not in the other's never exceeds the words that the other lacks."""
    sets = [[], ["a"], ["a", "b", "é"], [f"w{i}" for i in range(40)], [f"w{i}" for i in range(20, 900)]]
    rows = spark.createDataFrame([(w,) for w in sets], "w array<string>").select("w", F.array(*neardup.signature(F.col("w"))).alias("s")).collect()
    bits = lambda s: {64 * i + j for i, x in enumerate(s) for j in range(64) if x >> j & 1}
    for a in rows:
        assert len(bits(a.s)) <= len(a.w) and bool(bits(a.s)) == bool(a.w)
        for b in rows:
            assert len(bits(a.s) - bits(b.s)) <= len(set(a.w) - set(b.w))


def test_pairs_of_question_and_chunk_are_not_shuffled(spark):
    chunks = spark.createDataFrame([(i, f"the cat {i} sat") for i in range(20)], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "the cat 3"), (1, "sat 5 5")], "q long, question string")
    plan = index.scores(asked, chunks)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(q" not in plan


def test_partitions_grow_with_pairs_of_question_and_chunk(spark, tmp_path, monkeypatch):
    """A task sums up so many pairs at most; by bytes of texts or postings alone, its pairs would grow with the questions."""
    monkeypatch.setattr(index, "PAIRS", 2)
    chunks = spark.createDataFrame([(i, f"the cat {i} sat") for i in range(20)], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "the cat 3"), (1, "sat 5 5")], "q long, question string")
    index.write_index(chunks, str(tmp_path))
    for of in (None, index.read_index(spark, str(tmp_path))):
        found = index.scores(asked, chunks, of)
        assert "hashpartitioning(chunk_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
        assert found.count() == 40


def test_an_index_is_written_with_one_shuffle_of_counts(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "the cat the" if i % 2 else "The cat") for i in range(400)] + [(400, None), (401, "!!")], "chunk_id long, text string")
    plan = index.postings_by_term(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(term" in plan
    index.write_index(chunks, str(tmp_path))
    posted, lengths, terms = index.read_index(spark, str(tmp_path))
    assert posted.schema.simpleString() == index.postings(chunks).schema.simpleString()
    assert sorted(posted.collect()) == sorted(index.postings(chunks).collect())
    assert sorted(terms.collect()) == sorted(index.term_stats(chunks).collect()) and lengths.count() == 402
    # a term of all chunks is not one task's
    files = posted.where("term = 'the'").groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 400


def test_an_index_counts_a_repeated_chunk_once_for_a_term(spark, tmp_path):
    """As the SQL does: df is the number of postings."""
    chunks = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, "d")], "chunk_id long, text string")
    index.write_index(chunks, str(tmp_path))
    posted, _, terms = index.read_index(spark, str(tmp_path))
    assert {(r.term, r.chunk_id): r.tf for r in posted.collect()} == {("a", 1): 3, ("b", 1): 1, ("c", 1): 1, ("d", 2): 1}
    assert {r.term: r.df for r in terms.collect()} == {"a": 1, "b": 1, "c": 1, "d": 1}


def test_elements_are_counted_in_their_row(spark):
    from corpusloom.functions.text import counted

    rows = spark.createDataFrame([(0, ["b", "a", "b", "b"]), (1, []), (2, None), (3, ["x"])], "i int, w array<string>")
    got = {r.i: [tuple(c) for c in r.c or []] for r in rows.select("i", counted(F.col("w")).alias("c")).collect()}
    assert got == {0: [("a", 1), ("b", 3)], 1: [], 2: [], 3: [("x", 1)]}
