"""A progress log as keyed state: the last entry of every key, and entries that nobody has renewed in time.

Log files come in any order. For each key the state holds the entry with the latest time (of one time, the one with the largest rank, then
the one whose fields are last as text), on RocksDB, and a timer. An entry that is not renewed within `ttl` of event time, as the watermark has it, has expired: it is
put out once more, marked, so that its work can be given out again, and its state is dropped. Only keys of a batch are touched by it, whatever
the log has had before; what a batch changes is written to a folder of its own, the same when it is tried again.

    changes/batch=N     key, time, fields, expired

state() is the log as it stands, by the last change of each key. An entry that comes after its key has expired begins anew; one that is older than what is held changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .eventtime import PROVIDER, ROCKSDB


class Latest(StatefulProcessor):
    """Keeps the last entry of a key. Times are microseconds; fields are strings of JSON, which order and travel alike for every log."""

    def __init__(self, ttl_ms: int, key_type: T.DataType):
        self.ttl_ms = ttl_ms
        self.state_type = T.StructType([T.StructField("at", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("fields", T.StringType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        best = held
        for pdf in rows:
            # the rows of a key come by and by; only the best one is kept
            found = max(zip(pdf["at"].tolist(), pdf["rank"].tolist(), pdf["fields"].tolist()))
            best = found if best is None else max(best, found)
        if best != held:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.held.update(best)
            self.handle.registerTimer(best[0] // 1000 + self.ttl_ms)
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = tuple(self.held.get())
            self.held.clear()
            yield self._row(key, held, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, entry, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "at": [entry[0]], "fields": [entry[2]], "expired": [expired]})


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def follow(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, key: str, time: str, ttl: timedelta, rank: str | None = None, delay: str = "0 seconds") -> None:
    """Takes what is new of a stream of log entries. `time` is a timestamp column, `rank` one of whole numbers, nulls first. Entries without a key or a time are left out; no other is, however late."""
    fields = [c for c in stream.columns if c not in (key, time)]
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    ranked = F.coalesce(F.col(rank).cast("long"), F.lit(-(1 << 63))) if rank else F.lit(0).cast("long")
    # the watermark moves timers only: without its column, Spark takes no row for late
    rows = rows.select(F.col(key).alias("key"), F.unix_micros(time).alias("at"), ranked.alias("rank"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("fields"))
    schema = f"key {_kind(stream, key)}, at long, fields string, expired boolean"

    def write(batch: DataFrame, number: int) -> None:
        # a key that expires and comes anew in one batch is two changes of it
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        processor = Latest(int(ttl.total_seconds() * 1000), stream.schema[key].dataType)
        found = rows.groupBy("key").transformWithStateInPandas(processor, schema, "update", "EventTime")
        found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def changes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/changes")


def state(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """(key, at, the fields of `schema`, expired) as the last change of each key left it. Of the changes of a key in one batch, the later entry counts, then the expired one."""
    last = changes(spark, out).groupBy("key").agg(F.max(F.struct("batch", "at", "expired", "fields")).alias("_last"))
    return last.select("key", "_last.at", F.from_json("_last.fields", schema).alias("_f"), "_last.expired").select("key", F.timestamp_micros("at").alias("at"), "_f.*", "expired")
