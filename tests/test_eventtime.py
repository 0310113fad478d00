"""Event-time windows: three batches of files against one batch over the accepted rows; late rows; restarts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files
from corpusloom.streaming import eventtime
from corpusloom.streaming.eventtime import Windows

SCHEMA = "k string, at timestamp, v long"
KINDS = [Windows(size="10 minutes"), Windows(size="10 minutes", slide="3 minutes"), Windows(gap="4 minutes")]
DELAY = timedelta(minutes=5)


def at(minute, micros=0):
    return datetime(2024, 1, 1) + timedelta(minutes=minute, microseconds=micros)


#: Out of order in the delay and beyond it, at the edges of windows, and without a time.
BATCHES = [
    [("a", at(1), 1), ("a", at(9, 999_999), 2), ("b", at(12), 3), ("a", at(20), 4), ("a", None, 5)],
    [("a", at(14), 6), ("a", at(15), 7), ("a", at(3), 8), ("b", at(20), 9), ("a", at(41), 10), ("a", at(41), 10), (None, at(40), 11)],
    [("b", at(2), 12), ("b", at(35), 13), ("a", at(36, 1), 14), ("a", at(30), 15), ("a", at(90), 16), ("b", at(89), 17)],
]


class Run:
    def __init__(self, spark, folder, windows):
        self.spark, self.windows, self.source, self.out, self.checkpoint = spark, windows, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def go(self, per_batch=1):
        eventtime.run(self.spark, files.stream(self.spark, self.source, SCHEMA, per_batch), self.windows, self.out, self.checkpoint, "at", ["k"], "v", "5 minutes")

    def closed(self):
        return sorted(map(tuple, eventtime.closed(self.spark, self.out).collect()), key=repr)

    def expected(self):
        """A batch over what was accepted, of the windows that are closed now."""
        rows = eventtime.accepted(self.spark, self.out)
        mark = rows.agg(F.max("at")).first()[0] - DELAY
        return sorted((tuple(r) for r in eventtime.totals(rows, self.windows, "at", ["k"], "v").collect() if r.end <= mark), key=repr)


@pytest.mark.parametrize("windows", KINDS, ids=str)
def test_three_batches_equal_one_less_the_late_rows(spark, tmp_path, windows):
    run = Run(spark, tmp_path, windows)
    every = []
    for rows in BATCHES:  # a run, and so a restart, for each
        run.add(rows)
        every += rows
        run.go()
        assert run.closed() == run.expected()
    late, kept = ([tuple(r)[:3] for r in t(spark, run.out).collect()] for t in (eventtime.late, eventtime.accepted))
    assert sorted(late + kept, key=repr) == sorted(every, key=repr)
    assert ("a", None, 5) in late and ("a", at(3), 8) in late and ("b", at(2), 12) in late  # closed long before
    assert ("a", at(15), 7) in kept or windows.gap
    marks = spark.read.parquet(f"{run.out}/marks").orderBy("batch").collect()
    assert sum(m.late for m in marks) == len(late) and sum(m.n for m in marks) == len(every) and [m.high for m in marks] == [at(20), at(41), at(90)]
    before = run.closed()
    run.go()  # nothing new
    assert run.closed() == before


def test_only_windows_that_end_by_the_mark_are_closed(spark):
    """A row is late exactly if a window of its own ends by the mark."""
    times = spark.range(0, 60 * 60, 7).select(F.timestamp_seconds("id").alias("at"))
    for windows in KINDS[:2]:
        ends = times.withColumn("w", windows.of("at")).groupBy("at").agg(F.min("w.end").alias("end"))
        mark = F.timestamp_seconds(F.lit(1800))
        assert ends.where(windows.closed("at", mark) != (F.col("end") <= mark)).count() == 0


def test_a_batch_that_broke_off_is_parted_again(spark, tmp_path, monkeypatch):
    run = Run(spark, tmp_path, KINDS[0])
    run.add(BATCHES[0])
    run.go()
    run.add(BATCHES[1])
    whole = Windows.closed
    calls = []

    def broken(self, time, mark):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("gone")
        return whole(self, time, mark)

    monkeypatch.setattr(Windows, "closed", broken)
    with pytest.raises(Exception, match="gone"):
        run.go()
    run.go()
    assert run.closed() == run.expected() and eventtime.late(spark, run.out).count() + eventtime.accepted(spark, run.out).count() == 12


def test_settings_are_restored_and_state_is_on_disk(spark, tmp_path):
    before = spark.conf.get(eventtime.PROVIDER)
    run = Run(spark, tmp_path, KINDS[0])
    run.add([])
    run.go()
    assert spark.conf.get(eventtime.PROVIDER) == before
    assert run.closed() == []
