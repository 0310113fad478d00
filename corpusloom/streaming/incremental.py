"""Incremental forms: logs and indexes that are brought up to date with new files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import EPSILON, doc_lengths, postings
from ..operators.merge import last_wins


def update_index(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str) -> None:
    """Appends postings and lengths of chunks in new JSON files at `source`. Each batch has its own folder, so a retry writes it anew."""

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        postings(batch).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        doc_lengths(batch).write.mode("overwrite").parquet(f"{path}/lengths/batch={number}")
        batch.unpersist()

    rows = spark.readStream.schema(schema).json(source)
    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def indexed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, lengths and term statistics of an index that update_index() wrote; statistics come from the postings."""
    posted, lengths = spark.read.parquet(f"{path}/postings").drop("batch"), spark.read.parquet(f"{path}/lengths").drop("batch")
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(lengths.agg(F.count("*").alias("n")))).withColumn("raw", F.ln(F.col("n") - F.col("df") + F.lit(0.5)) - F.ln(F.col("df") + F.lit(0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.lit(EPSILON) * F.col("mean")).alias("idf"))
    return posted, lengths, terms


def follow_log(spark: SparkSession, source: str, schema: str, key: str, order: str, out: str, checkpoint: str) -> None:
    """Writes, for each batch of new files of a JSON log, the last row of each key; last_of_log() reads the last of all."""

    def merge(batch: DataFrame, number: int) -> None:
        last_wins(batch.withColumn("_order", F.col(order)), key, order="_order").drop("_order").write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).json(source)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_of_log(spark: SparkSession, out: str, key: str, order: str) -> DataFrame:
    rows = spark.read.parquet(out).drop("batch")
    return last_wins(rows.withColumn("_order", F.col(order)), key, order="_order").drop("_order")
