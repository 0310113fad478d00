"""Windows of event time over files that arrive out of order: tumbling, sliding, and sessions, with what came too late on record.

A run takes the files that are new in two streams, one after the other, each with a checkpoint of its own:

1. Rows are parted by a mark, the latest time that earlier batches have seen less the delay. A row that a closed window would have had goes to the
   late table, all others are accepted; so windows agree about their rows, and nothing is lost unseen. A batch that is tried again
   sees the same marks, and writes the same to the same place.
2. A watermark of the same delay over the accepted rows closes windows, which are written when they are. The second stream's
   watermark is never ahead of the first's marks, so it drops no row itself: its windows are those of a batch over the accepted rows.

    accepted/batch=N, late/batch=N     rows of a batch of files
    marks/batch=N                      one row: latest time so far, number of rows, late ones
    windows/batch=N                    windows that were closed: keys, start, end, n, total

State is what the open windows hold, in RocksDB; one row for each window and key. A window that is open at the end of a run is closed by a later one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Windows:
    """Windows of `size`, one beginning at every `slide`; or, with a `gap`, sessions that end so long after their last row. Durations as in `10 minutes`."""

    size: str | None = None
    slide: str | None = None
    gap: str | None = None

    def of(self, time: str) -> Column:
        return F.session_window(time, self.gap) if self.gap else F.window(time, self.size, self.slide or self.size)

    def closed(self, time: str, mark: Column) -> Column:
        """Whether a window with a row of this time can be closed at the mark. The first of sliding windows is the one that ends first; a session that ends by the mark has no row after it."""
        if self.gap:
            return F.col(time) <= mark
        # windows end at places a slide apart; the first one that has the row ends at the next place after it
        slide, size = (F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {x})") for x in (self.slide or self.size, self.size))
        at = F.unix_micros(time)
        return F.timestamp_micros(at - F.pmod(at - size, slide) + slide) <= mark


def totals(rows: DataFrame, windows: Windows, time: str, keys: list[str], value: str) -> DataFrame:
    """(keys, start, end, n, total) by window, of a table or a stream."""
    found = rows.groupBy(*keys, windows.of(time).alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a folder for each batch, which may not be there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path)


MARKS = "high timestamp, n long, late long"


def run(spark: SparkSession, stream: DataFrame, windows: Windows, out: str, checkpoint: str, time: str, keys: list[str], value: str, delay: str) -> None:
    """Takes what is new of a stream of files into the tables at `out`. `time` is a timestamp column; rows without one are late."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def part(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        high = _batches(session, f"{out}/marks", MARKS).where(F.col("batch") < number).agg(F.max("high")).first()[0]
        seen = F.lit(high).cast("timestamp")
        late = F.col(time).isNull() if high is None else F.col(time).isNull() | windows.closed(time, seen - F.expr(f"interval {delay}"))
        judged = batch.withColumn("_late", late)
        judged.where("not _late").drop("_late").write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        judged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        counts = judged.agg(F.greatest(F.max(time), seen).alias("high"), F.count("*").alias("n"), F.count_if("_late").alias("late"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")

    def close(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/windows/batch={number}")

    stream.writeStream.foreachBatch(part).option("checkpointLocation", f"{checkpoint}/rows").trigger(availableNow=True).start().awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/accepted")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return  # nothing has ever come
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        accepted = spark.readStream.schema(f"{schema}, batch long").parquet(f"{out}/accepted").drop("batch").withWatermark(time, delay)
        found = totals(accepted, windows, time, keys, value)
        found.writeStream.outputMode("append").foreachBatch(close).option("checkpointLocation", f"{checkpoint}/windows").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def closed(spark: SparkSession, out: str) -> DataFrame:
    """The windows that are closed."""
    return spark.read.parquet(f"{out}/windows").drop("batch")


def late(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/late")


def accepted(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/accepted")
