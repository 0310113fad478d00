from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.index import top_k
from corpusloom.sources import fetch, jsonl
from corpusloom.streaming import incremental


def test_tolerant_and_strict(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"url": "a", "title": "é"}\n\n  \n{bad\n{"title": "no url"}\n{"url": "b", "extra": 1}\n')
    assert [tuple(r) for r in jsonl.read_tolerant(spark, str(p)).orderBy("url").collect()] == [("a", "é", None), ("b", None, None)]
    assert [r.url for r in jsonl.logged_keys(spark, str(p), "url string").orderBy("url").collect()] == ["a", "b"]
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), "url string").collect()


def test_lines_keep_positions(spark, tmp_path):
    p = tmp_path / "q.txt"
    p.write_text(" one \n\ntwo\r\nthree\n")
    assert [tuple(r) for r in jsonl.read_lines(spark, str(p), "question", strip=True).orderBy("pos").collect()] == [(0, "one"), (1, ""), (2, "two"), (3, "three")]
    rows = jsonl.read_lines(spark, str(p), "x").withColumn("x", F.when(F.col("pos") == 2, None).otherwise(F.col("x")))
    jsonl.write_lines(rows, str(tmp_path / "out"), "x")
    assert next((tmp_path / "out").glob("part*")).read_text() == " one \n\n\nthree\n"


def test_pages_of_a_manifest(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_bytes(b"<p>\xff\xc3\xa9</p>")
    (tmp_path / "m.jsonl").write_text('{"url": "u", "filename": "a.html", "timestamp": 1.5}\n{"url": "v", "filename": "gone.html", "timestamp": 2}\n')
    got = jsonl.read_pages(spark, jsonl.read_manifest(spark, str(tmp_path / "m.jsonl")), str(tmp_path / "raw")).collect()
    assert [(r.url, r.timestamp, r.html) for r in got] == [("u", 1.5, "<p>�é</p>")]


def test_squad_files(spark, tmp_path):
    data = {"version": "1.1", "data": [{"paragraphs": [{"qas": [{"id": "1", "answers": [{"text": "x"}, {"text": "y"}]}]}]}]}
    (tmp_path / "d.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "p.json").write_text('{"1": "x", "2": "z"}')
    assert [tuple(r) for r in jsonl.read_squad(spark, str(tmp_path / "d.json")).collect()] == [("1", ["x", "y"])]
    assert jsonl.read_squad_version(spark, str(tmp_path / "d.json")) == "1.1"
    assert sorted(tuple(r) for r in jsonl.read_predictions(spark, str(tmp_path / "p.json")).collect()) == [("1", "x"), ("2", "z")]


def test_round_trip_and_append(spark, tmp_path):
    rows = spark.createDataFrame([("ü", None)], "url string, title string").coalesce(1)
    jsonl.write_jsonl(rows, str(tmp_path / "o"))
    assert '"ü"' in next((tmp_path / "o").glob("part*")).read_text()
    for _ in range(2):
        jsonl.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_fetch(spark):
    pages = {"a": "A"}
    rows = spark.createDataFrame([("a",), ("b",)], "url string")
    assert sorted((r.url, r.html) for r in fetch.fetch(rows, pages.get, 2).collect()) == [("a", "A"), ("b", None)]
    assert fetch.http_fetcher(0.01)("not a url") is None
    archive = fetch.Archive(spark.createDataFrame([("a", "A"), ("c", "C")], "url string, html string"))
    assert sorted((r.url, r.html) for r in fetch.fetch(rows, archive).collect()) == [("a", "A"), ("b", None)]


def test_incremental_index(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = "chunk_id long, text string"
    texts = ["the cat", "a dog and a cat", "fish", "the sun", "moon"]
    for part in ([0, 1], [2, 3, 4]):
        spark.createDataFrame([(i, texts[i]) for i in part], schema).coalesce(1).write.mode("append").json(source)
        incremental.update_index(spark, source, schema, out, mark)
    asked = spark.createDataFrame([(0, "cat the")], "q long, question string")
    chunks = spark.createDataFrame(list(enumerate(texts)), schema)
    got = top_k(asked, chunks, 3, incremental.indexed(spark, out)).orderBy("rank").collect()
    assert got == top_k(asked, chunks, 3).orderBy("rank").collect()


def test_followed_log(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for rows in ([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("b", 3, "w")]):
        spark.createDataFrame(rows, "url string, n long, text string").coalesce(1).write.mode("append").json(source)
        incremental.follow_log(spark, source, "url string, n long, text string", "url", "n", out, mark)
    assert sorted((r.url, r.n, r.text) for r in incremental.last_of_log(spark, out, "url", "n").collect()) == [("a", 2, "y"), ("b", 3, "w")]
