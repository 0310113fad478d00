"""The jobs: their queries against SQL, growing input, retries, reruns, and rows that are odd. All on copies."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from jobs import common, passage_feed, qa_release, queries

DOCUMENTS = "doc_id long, text string, source string, lang string, n_chars int"
TURNS = "conv_id long, turn int, role string, text string"
#: What the queries must give on tables that have every odd case.
LONG = " ".join(f"w{i}" for i in range(900))
ODD_DOCUMENTS = [
    (1, LONG, "s", "en", 1), (2, "x" * 49, "s", "en", 1), (3, "y" * 50, "s", "", 1), (4, None, "s", "en", 1), (5, "", "s", None, 1), (6, LONG + " é", None, "12", 1),
    (7, "older " * 20, "s", "en", 1), (7, "zzzz newer " * 20, "t", "de", 1), (8, LONG, "s", "a/b=c d", 1), (8, LONG, "s", "a/b=c d", 1),
]
ODD_TURNS = [
    (1, 0, "user", "What is a loom?"), (1, 1, "assistant", 'Answer: "a machine"'), (1, 2, "user", "what is a LOOM"), (1, 3, "assistant", "again"),
    (2, 0, "user", "?!"), (2, 1, "assistant", "words"), (2, 2, "user", "Who knows it all?"), (2, 3, "assistant", "unknown"), (3, 0, "user", "Is there more to say?"),
    (4, 0, "user", None), (4, 1, "assistant", "to nothing"), (5, 0, "user", "Where does the été go?"), (5, 1, "assistant", None), (6, 0, "user", "twice b"), (6, 0, "user", "twice a"),
    (6, 1, "assistant", "line\nbreak"), (7, 0, "system", "x"), (7, 1, "assistant", "y"), (None, 0, "user", "no conversation"), (8, None, "user", "no turn"), (9, 0, "user", "long " + LONG), (9, 1, "assistant", "'" + LONG + "'"),
]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.fixture()
def odd(spark, tmp_path):
    spark.createDataFrame(ODD_DOCUMENTS, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ODD_TURNS, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_odd_turns_match_sql(odd, same):
    same(queries.QUERIES["job2_qa_release"], queries.SQL["job2_qa_release"], odd)


def test_odd_documents_match_sql(spark, odd, same, tmp_path):
    # versions of one document in one file, as SQL doesn't know files' times
    spark.createDataFrame(ODD_DOCUMENTS, DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    same(queries.QUERIES["job1_passage_feed"], queries.SQL["job1_passage_feed"], f"{tmp_path}/one")


@pytest.mark.parametrize("name, table, schema", [("job1_passage_feed", "documents", DOCUMENTS), ("job2_qa_release", "conversations", TURNS)])
def test_empty_tables(spark, tmp_path, name, table, schema):
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


class Feed:
    """A growing source, and what the job makes of it."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.out, self.checkpoint = spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"

    def add(self, *rows):
        self.spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, **options):
        return passage_feed.run(self.spark, self.source, self.out, self.checkpoint, size=40, overlap=10, **options)

    def passages(self):
        rows = passage_feed.current(self.spark, self.out).select("doc_id", "lang", "section_idx", "part_idx", "text")
        return sorted(map(tuple, rows.collect()), key=repr)


def text(word, n):
    return " ".join(f"{word}{i}" for i in range(n))


def test_two_runs_over_growing_input(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add((1, text("a", 100), "s", "en", 0), (2, text("b", 60), "s", "de", 0), (3, text("c", 30), "s", "en", 0), (None, "lost", "s", "en", 0))
    log = feed.run().collect()
    assert [(r.rows, r.documents, r.rejected) for r in log] == [(4, 3, 1)]
    before = feed.passages()
    # a new document, one that changes its text and language, one that goes, and one that comes again as it was
    feed.add((4, text("d", 45), "s", None, 0), (2, text("B", 90), "t", "en", 0), (3, None, "s", "en", 0), (1, text("a", 100), "s", "en", 0))
    log = feed.run().collect()
    assert sorted((r.batch, r.rows, r.documents) for r in log) == [(0, 4, 3), (1, 4, 4)]  # only what is new was read
    now = feed.passages()
    assert {r[0] for r in now} == {1, 2, 4} and not any("b0" in r[4] for r in now) and {r[1] for r in now if r[0] == 2} == {"en"}
    assert [r for r in now if r[0] == 1] == [r for r in before if r[0] == 1]
    # the same as all of it at once, and as a third run without anything new
    assert feed.run().count() == 2 and feed.passages() == now
    whole = Feed(spark, tmp_path / "whole")
    whole.source = feed.source
    whole.run(files_per_batch=1)
    assert whole.passages() == now
    docs = {r.doc_id: r.text for r in passage_feed.current(spark, feed.out, "documents").collect()}
    assert docs == {1: text("a", 100), 2: text("B", 90), 3: None, 4: text("d", 45)}


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    feed = Feed(spark, tmp_path)
    feed.add((1, text("a", 100), "s", "en", 0), (2, text("b", 60), "s", "de", 0))
    feed.run()
    feed.add((2, text("c", 70), "s", "en", 0), (3, text("d", 50), "s", "de", 0))
    write = passage_feed._write

    def broken(rows, out, table, number):
        write(rows, out, table, number)
        if table == "passages":
            raise OSError("gone")

    monkeypatch.setattr(passage_feed, "_write", broken)
    with pytest.raises(Exception, match="gone"):
        feed.run()
    monkeypatch.setattr(passage_feed, "_write", write)
    assert sorted(r.batch for r in feed.run().collect()) == [0, 1]
    whole = Feed(spark, tmp_path / "whole")
    whole.source = feed.source
    whole.run()
    assert feed.passages() == whole.passages()


def test_partitions_and_clashing_columns(spark, odd):
    passage_feed.run(spark, f"{odd}/documents.parquet", f"{odd}/out", f"{odd}/checkpoint")
    rows = passage_feed.current(spark, f"{odd}/out")
    assert {r.lang for r in rows.select("lang").distinct().collect()} == {"en", "12", "de", "a/b=c d", None}
    plan = rows.where("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan


def test_release_is_written_whole_and_again(spark, odd):
    run = lambda name, **options: sorted(map(tuple, qa_release.run(spark, f"{odd}/conversations.parquet", f"{odd}/out", name, **options).collect()), key=repr)
    first = run("one")
    assert sum(r[2] for r in first) == 11  # each question has one outcome
    outcomes = {}
    for outcome, _, n, _ in first:
        outcomes[outcome] = outcomes.get(outcome, 0) + n
    assert outcomes == {"kept": 3, "repeated": 1, "blank": 2, "unknown": 2, "unanswered": 3}
    read = lambda name: sorted(map(tuple, spark.read.json(f"{odd}/out/pairs/release={name}").collect()), key=repr)
    rows = read("one")
    assert run("one") == first and read("one") == rows
    # another release leaves the first alone; a share of nothing leaves no split behind
    run("two", splits=[["train", 1.0], ["test", 0.0]])
    assert read("one") == rows and {r[-1] for r in read("two")} == {"train"}
    run("one", splits=[["all", 1.0]])
    assert {r[-1] for r in read("one")} == {"all"}
    with pytest.raises(ValueError, match="add up"):
        run("three", splits=[["train", 0.5]])


def test_conversations_are_in_one_split(spark):
    rows = spark.range(4000).select(F.col("id").alias("conv_id")).withColumn("split", qa_release.split_of("conv_id", qa_release.SPLITS, 7))
    n = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    assert abs(n["train"] / 4000 - 0.8) < 0.03 and abs(n["dev"] / 4000 - 0.1) < 0.02 and set(n) == {"train", "dev", "test"}


def test_command_lines(spark, odd, tmp_path, monkeypatch):
    """The config file comes first, options go before it; the session that is made is stopped."""
    (tmp_path / "c.json").write_text(json.dumps({"source": f"{odd}/nowhere", "out": f"{odd}/cli", "release": "r", "splits": [["train", 0.5], ["test", 0.5]]}))
    stopped = []
    monkeypatch.setattr(type(spark), "stop", lambda self: stopped.append(self))
    common.main("qa_release", qa_release.run, ("source", "out", "release"), ["--config", f"{tmp_path}/c.json", "--source", f"{odd}/conversations.parquet"])
    assert stopped and spark.read.json(f"{odd}/cli/report/release=r").count() > 0
    (tmp_path / "d.json").write_text(json.dumps({"source": f"{odd}/documents.parquet", "out": f"{odd}/feed", "checkpoint": f"{odd}/feed-checkpoint"}))
    common.main("passage_feed", passage_feed.run, ("source", "out", "checkpoint"), ["--config", f"{tmp_path}/d.json"])
    assert passage_feed.current(spark, f"{odd}/feed").count() > 0


@pytest.mark.parametrize("name", ["passage_feed", "qa_release"])
def test_config_files_fit(name):
    import inspect

    from .conftest import ROOT

    job = {"passage_feed": passage_feed, "qa_release": qa_release}[name]
    with open(f"{ROOT}/jobs/{name}.json") as file:
        assert set(json.load(file)) <= set(inspect.signature(job.run).parameters)
