"""The progress log as state: equal to the last entry of each key, across restarts; expiry; late and odd entries."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import merge
from corpusloom.sources import files
from corpusloom.streaming import eventtime, progress

SCHEMA = "url string, at timestamp, title string, text string, llm_cleaned boolean, n long"


def at(hour, micros=0):
    return datetime(2024, 1, 1) + timedelta(hours=hour, microseconds=micros)


class Log:
    def __init__(self, spark, folder, ttl):
        self.spark, self.source, self.out, self.checkpoint, self.ttl = spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", ttl

    def add(self, *rows):
        self.spark.createDataFrame([(u, t, title, "text " + str(title), n % 2 == 0, n) for u, t, title, n in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def follow(self):
        progress.follow(self.spark, files.stream(self.spark, self.source, SCHEMA, 1), self.out, self.checkpoint, "url", "at", self.ttl, rank="n")

    def state(self):
        rows = progress.state(self.spark, self.out, "title string, text string, llm_cleaned boolean, n long")
        return {r.key: (r.at, r.title, r.n, r.expired) for r in rows.collect()}

    def last(self):
        rows = self.spark.read.parquet(self.source).where("url is not null and at is not null")
        best = merge.last_wins(rows.withColumn("ord", F.struct("at", "n")), "url")
        return {r.url: (r.at, r.title, r.n, False) for r in best.collect()}


def test_state_is_the_last_entry_of_each_key_across_restarts(spark, tmp_path):
    log = Log(spark, tmp_path, timedelta(days=1000))
    log.add(("u1", at(1), "a", 1), ("u2", at(5, 3), "b", 2), ("u1", at(2), "c", 3), (None, at(3), "lost", 4), ("u3", None, "lost", 5))
    log.follow()
    assert log.state() == log.last() == {"u1": (at(2), "c", 3, False), "u2": (at(5, 3), "b", 2, False)}
    # older than what is held; older than all, of a key that is new; equal times; and one that comes again
    log.add(("u2", at(5), "old", 6), ("u4", at(0), "late", 7), ("u1", at(2), "tie", 9), ("u1", at(2), "tie less", 8), ("u2", at(5, 3), "b", 2))
    log.follow()
    assert log.state() == log.last() and log.state()["u1"][1] == "tie" and log.state()["u4"][1] == "late"
    # what did not change isn't put out again
    assert {r.key for r in progress.changes(spark, log.out).where("batch >= 1").collect()} == {"u1", "u4"}
    before = log.state()
    log.follow()
    assert log.state() == before


def test_entries_that_nobody_renews_expire(spark, tmp_path):
    log = Log(spark, tmp_path, timedelta(hours=10))
    log.add(("u1", at(0), "a", 1), ("u2", at(1), "b", 2))
    log.follow()
    log.add(("u1", at(9), "renewed", 3), ("u3", at(12), "c", 4))
    log.follow()
    state = log.state()
    assert state["u2"] == (at(1), "b", 2, True) and state["u1"] == (at(9), "renewed", 3, False) and not state["u3"][3]
    # its state is gone: an entry that comes now begins anew, even one that is older
    log.add(("u2", at(0), "anew", 5), ("u3", at(13), "d", 6))
    log.follow()
    assert log.state()["u2"][:3] == (at(0), "anew", 5)


def test_settings_are_restored(spark, tmp_path):
    before = spark.conf.get(eventtime.PROVIDER)
    log = Log(spark, tmp_path, timedelta(hours=1))
    log.add(("u", at(0), "a", 1))
    log.source += "-none"
    with pytest.raises(Exception, match="none"):
        log.follow()
    assert spark.conf.get(eventtime.PROVIDER) == before
