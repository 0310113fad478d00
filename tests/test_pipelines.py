"""Whole runs over files."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.plans import pipelines as P

LONG = "is a sentence of the page that is long enough to be kept as a line"


def lines(path):
    return [json.loads(x) for f in sorted(Path(path).glob("part*")) for x in f.read_text().splitlines()]


def write(path, rows):
    Path(path).write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_from_pages_to_scores(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "raw").mkdir()
    for name, body in (("a", f"<title>Cats | Site</title><h2>Food</h2><p>Fish {LONG}</p><h2>Sleep</h2><p>Sofa {LONG}</p>"), ("b", f"<p>Dogs {LONG}, and they eat bones.</p>"), ("c", "<p>short</p>")):
        (tmp_path / "raw" / f"{name}.html").write_text(body)
    manifest = write(at("m.jsonl"), [{"url": f"http://s/{n}", "filename": f"{n}.html", "timestamp": 1.0} for n in "abcd"])
    main(["corpus", manifest, at("raw"), at("corpus"), at("chunks")], spark)
    assert sorted(x["url"] for x in lines(at("corpus"))) == ["http://s/a", "http://s/b"]
    chunks = lines(at("chunks"))
    assert sorted((c["url"], c["section"]) for c in chunks) == [("http://s/a", "Food"), ("http://s/a", "Sleep"), ("http://s/b", "")]
    assert any(c["text"].startswith("Cats > Food\nFish") for c in chunks) and len({c["chunk_id"] for c in chunks}) == 3
    main(["chunk", at("corpus"), at("again")], spark)
    assert sorted(c["section"] for c in lines(at("again"))) == ["", "Food", "Sleep"]
    main(["index", at("chunks"), at("index")], spark)
    Path(at("q.txt")).write_text("What do dogs eat?\n\nwhere is the sofa\n")
    main(["answer", at("q.txt"), at("index"), at("answers")], spark)
    said = next(Path(at("answers")).glob("part*")).read_text().split("\n")
    assert len(said) == 4 and said[1] == "unknown" and said[0] != "unknown"
    gold = write(at("gold.jsonl"), [{"question": "What do dogs eat?", "answer": "bones|fish", "url": "u"}, {"question": "x", "answer": "y", "url": "u"}, {"question": "where is the sofa", "answer": "nowhere at all", "url": "u"}, {"question": "not asked", "answer": "z", "url": "u"}])
    Path(at("p.txt")).write_text("Bones!\nno\nat all\n")
    report = P.score_answers(spark, at("p.txt"), gold, at("index")).first()
    assert (report.n, report.em, report.recall) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))  # "y" is found inside a word
    assert report.f1 == pytest.approx((1 + 0 + 0.8) / 3)
    assert main(["score", at("p.txt"), gold], spark) == "n: 3\nem: 0.3333\nf1: 0.6000"


def test_rewriting_is_resumed(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    corpus = write(at("c.jsonl"), [{"url": u, "title": "t", "text": u * n} for u, n in (("a", 60), ("b", 60), ("s", 10))])
    seen = tmp_path / "seen"
    seen.mkdir()

    def model(prompt):
        u = prompt.rstrip()[-1]
        (seen / f"{u}{len(list(seen.iterdir()))}").touch()
        return "clean " * 10 if u == "a" else None

    first = P.rewrite_corpus(spark, corpus, at("log"), at("out"), model, 1).first()
    assert (first.done, first.cleaned, first.failed) == (3, 1, 2) and len(list(seen.iterdir())) == 2
    P.rewrite_corpus(spark, corpus, at("log"), at("out"), model, 1)
    assert len(list(seen.iterdir())) == 2
    P.rewrite_corpus(spark, corpus, at("log"), at("out"), model, 1, retry_failed=True)
    assert len(list(seen.iterdir())) == 3
    assert {x["url"]: x["text"][:5] for x in lines(at("out"))} == {"a": "clean", "b": "bbbbb", "s": "sssss"}


def test_merging_files(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    body = "x" * 40
    ours = write(at("o.jsonl"), [{"url": "http://S/a/", "title": "A", "text": "old" + body}, {"url": "http://s/a", "title": "A", "text": "new" + body}, {"url": "http://s/short", "text": "x"}])
    theirs = write(at("t.jsonl"), [{"url": "http://s/a", "text": "no" + body}, {"url": "http://s/b", "text": "one" + body}, {"url": "http://s/b#f", "text": "two" + body}])
    extra = spark.createDataFrame([("http://s/b?x=1",), ("http://s/c",), ("http://s/gone",)], "url string")
    P.merge_corpora(spark, ours, theirs, at("out"), extra, {"http://s/c": f"<p>C {LONG}</p>"}.get)
    assert {x["url"]: x["text"][:3] for x in lines(at("out"))} == {"http://s/a": "new", "http://s/b": "one", "http://s/c": "C i"}


def test_crawl_then_resume(spark, tmp_path):
    site = {"http://s.org": '<a href="/a">a</a>', "http://s.org/a": '<a href="/b">b</a>', "http://s.org/b": "end"}
    out = str(tmp_path / "pages")
    P.crawl_site(spark, ["http://s.org"], "s.org", out, site.get, budget=2)
    P.crawl_site(spark, ["http://s.org"], "s.org", out, site.get, budget=9, resume=True)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == sorted(site)


def test_question_generation(spark, tmp_path):
    page = f"<p>Ada {LONG}.</p>" * 5
    cats = spark.createDataFrame([("people", ["http://s.org"], 3, 2, "names")], "category string, seeds array<string>, cap int, n_q int, hint string")
    raw = '{"question": "Who is on the page?", "answer": "Ada"}\n{"question": "Who is on this page?", "answer": "Ada|Bob"}\n{"question": "Other", "answer": "not there"}'
    counts = P.generate_questions(spark, cats, "s.org", str(tmp_path / "log"), str(tmp_path / "out"), {"http://s.org": page}.get, lambda prompt: raw if "names" in prompt else None)
    assert [tuple(r) for r in counts.collect()] == [("people", 3)]
    assert len(lines(tmp_path / "out")) == 2 and {x["answer"] for x in lines(tmp_path / "out")} == {"Ada", "Ada|Bob"}


def test_squad_command(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"version": "1.1", "data": [{"paragraphs": [{"qas": [{"id": "1", "answers": [{"text": "the x"}]}, {"id": "2", "answers": [{"text": "y"}]}]}]}]}))
    (tmp_path / "p.json").write_text('{"1": "X!"}')
    assert json.loads(main(["squad", str(tmp_path / "d.json"), str(tmp_path / "p.json")], spark)) == {"exact_match": 50.0, "f1": 50.0, "total": 2}


def test_a_rewriting_that_breaks_off_repeats_no_call(spark, tmp_path, monkeypatch):
    at = lambda x: str(tmp_path / x)
    corpus = write(at("c.jsonl"), [{"url": f"u{i:02d}", "title": "t", "text": "word " * 20 + f"u{i:02d}"} for i in range(30)])
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(prompt):
        name = prompt.rstrip()[-3:]
        (calls / f"{name}-{len(list(calls.glob(name + '*')))}").touch()
        return f"a clean text of more than thirty characters {name}"

    append, done = P.jsonl.append_log, []

    def broken(rows, path):
        append(rows, path)
        done.append(1)
        if len(done) == 3:
            raise KeyboardInterrupt

    monkeypatch.setattr(P.jsonl, "append_log", broken)
    with pytest.raises(KeyboardInterrupt):
        P.rewrite_corpus(spark, corpus, at("log"), at("out"), model, batch=5)
    before = len(list(calls.iterdir()))
    assert 0 < before < 30
    counters = P.rewrite_corpus(spark, corpus, at("log"), at("out"), model, batch=5).first()
    assert counters.done == 30 and sorted(f.name for f in calls.iterdir()) == [f"u{i:02d}-0" for i in range(30)]
    assert len(lines(at("out"))) == 30 and all("clean" in r["text"] for r in lines(at("out")))


def test_a_crawl_that_breaks_off_has_its_pages(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetcher(url):
        i = int(url.rsplit("/", 1)[1])
        (asked / f"{i}-{len(list(asked.glob(f'{i}-*')))}").touch()
        if i == 7 and len(list(asked.glob("7-*"))) == 1:
            raise KeyboardInterrupt
        return f'<a href="/{2 * i}">x</a><a href="/{2 * i + 1}">y</a>' if i < 10 else "leaf"

    out = str(tmp_path / "pages")
    with pytest.raises(Exception):
        P.crawl_site(spark, ["http://s.org/1"], "s.org", out, fetcher, budget=15, batch=2)
    stored = {r.url for r in spark.read.parquet(out).collect()}
    assert {"http://s.org/1", "http://s.org/2", "http://s.org/3"} <= stored and len(stored) < 8
    P.crawl_site(spark, ["http://s.org/1"], "s.org", out, fetcher, budget=15, resume=True, batch=2)
    urls = [r.url for r in spark.read.parquet(out).collect()]
    assert len(urls) == len(set(urls)) == 15
    assert all(len(list(asked.glob(f"{u.rsplit('/', 1)[1]}-*"))) == 1 for u in stored)


def test_the_last_line_of_a_log_counts_and_the_first_of_another_corpus(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    log = Path(at("log"))
    log.mkdir()
    for k, text in enumerate(["first try", "second try", "third try"]):  # names in the other order
        write(log / f"part-{9 - k}.json", [{"url": "a", "title": "", "text": text, "text_original": "o", "llm_cleaned": k < 2}])
        import os

        os.utime(log / f"part-{9 - k}.json", (1000 + k, 1000 + k))
    assert [(r.text, r.llm_cleaned) for r in P.progress_log(spark, str(log)).collect()] == [("third try", False)]
    ours, theirs = Path(at("ours")), Path(at("theirs"))
    for folder in (ours, theirs):
        folder.mkdir()
        for k in range(4):
            write(folder / f"part-{k}.json", [{"url": "http://x/1", "title": "", "text": f"{folder.name} {k} " + "and some more text to keep" * (9 - k)}] + [{"url": f"http://{folder.name}/{k}", "title": "", "text": "y" * 40}])
            os.utime(folder / f"part-{k}.json", (2000 + k, 2000 + k))
    P.merge_corpora(spark, str(ours), str(theirs), at("out"))
    got = {r["url"]: r["text"] for r in lines(at("out"))}
    assert got["http://x/1"].startswith("ours 3 ") and len(got) == 9
    P.merge_corpora(spark, write(at("none.jsonl"), [{"url": "http://y/1", "title": "", "text": "z" * 40}]), str(theirs), at("out2"))
    assert {r["url"]: r["text"] for r in lines(at("out2"))}["http://x/1"].startswith("theirs 0 ")


def test_other_versions_of_the_dataset_are_warned_of(spark, tmp_path):
    data = {"version": "2.0", "data": [{"paragraphs": [{"qas": [{"id": "1", "answers": [{"text": "yes"}]}]}]}]}
    (tmp_path / "d.json").write_text(json.dumps(data))
    (tmp_path / "p.json").write_text(json.dumps({"1": "Yes"}))
    with pytest.warns(UserWarning, match="2.0"):
        assert P.score_squad(spark, str(tmp_path / "d.json"), str(tmp_path / "p.json")).first().exact_match == 100


def test_lines_end_as_unicode_has_it(spark, tmp_path):
    text = "a\u2028b\x0bc\r\nd\x85\x1ce\r\rf\n"
    (tmp_path / "t.txt").write_text(text, newline="")
    assert [r.line for r in P.jsonl.read_lines(spark, str(tmp_path / "t.txt"), "line").orderBy("pos").collect()] == text.splitlines()


def test_batches_of_a_log_are_in_order_whatever_the_times_of_files(spark, tmp_path):
    """A copied log: all files of one time, names that sort the other way. Rows without a batch come first."""
    entry = lambda text: [("a", "", text, None, True)]
    frame = lambda text: spark.createDataFrame(entry(text), "url string, title string, text string, text_original string, llm_cleaned boolean").coalesce(1)
    log = tmp_path / "log"
    for k, text in enumerate(["first", "second", "third"]):
        number = P.jsonl.next_batch(spark, str(log)) if log.exists() else None
        assert number == (None if k == 0 else k)
        P.jsonl.append_log(frame(text) if number is None else frame(text).withColumn("batch", F.lit(number)), str(log))
        new = [f for f in log.glob("part-*.json") if not f.name.startswith("part-x")]
        new[0].rename(log / f"part-x{9 - k}.json")
    for f in log.glob("part-x*"):
        os.utime(f, (1000, 1000))
    for crc in log.glob(".*.crc"):
        crc.unlink()
    assert [r.text for r in P.progress_log(spark, str(log)).collect()] == ["third"]


def test_answers_leave_by_slices(spark):
    """A failure of one prompt is its own, and a slice's answers leave before the next prompts of a batch are Python objects."""
    from corpusloom.operators import generate

    rows = spark.range(200).coalesce(1).select("id", F.when(F.col("id") != 7, F.col("id").cast("string")).alias("prompt"), F.current_timestamp().alias("at"))
    got = generate.generated(rows, "prompt", lambda p: str(int(p) * 2))
    made = {r.id: (r.raw, r.error) for r in got.collect()}
    assert made.pop(7)[1].startswith("TypeError")
    assert made == {i: (str(2 * i), None) for i in range(200) if i != 7}
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_documents_are_not_sorted_to_be_chunked(spark, tmp_path, monkeypatch):
    rows = [(f"u{i % 3}", "T", "word " * (500 + i)) for i in range(6)]
    spark.createDataFrame(rows, "url string, title string, text string").write.json(str(tmp_path / "corpus"))
    monkeypatch.setattr(P, "with_doc_ids", lambda docs: pytest.fail("texts are sorted and written"))
    P.chunk_corpus(spark, str(tmp_path / "corpus"), str(tmp_path / "chunks"))
    got = sorted((r.chunk_id, r.url, r.section) for r in spark.read.json(str(tmp_path / "chunks")).collect())
    assert got == [(2 * i + p, f"u{i // 2}", f"part {p + 1}") for i in range(6) for p in range(2)]
