"""Streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 256) -> DataFrame:
    """A stream of the Parquet files of a folder; or of one file, which is read as what its folder has of that name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)
