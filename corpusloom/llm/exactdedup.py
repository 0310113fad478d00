"""Operator 4, exact deduplication by a stateful stream.

A stream reads the table's files and writes an entry for each row: digest of the normalised text, identifier, rank and a content
locator (file and row) by which its bytes can be read again. A stateful stream reads the entries and keeps, for each digest, one
entry of state that never expires: the row that stays so far and the number of rows. The state lives on disk, in RocksDB, with its
checkpoint in the shared folder; a run on the same folder goes on where the last one ended.
Every hit is checked on full bytes: the texts of rows whose digest is not alone are read again by their locators, and all of
a digest must be the same. Should digests collide, the groups concerned are formed again by whole text. Texts are read twice in all.

Spark combines rows of a digest before each shuffle, so a group with a third of all rows is one row from each task.

Texts are equal when they are the same without the characters of [\\x20\\x09-\\x0D]. Of equal texts the longest original stays, then
the smallest id, then the smallest locator.

Defined cases: null counts as empty; null ids come last; repeated rows are rows of one group; very long texts are read whole; an empty
table gives an empty result; extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small

#: State on disk; without files that are allocated ahead, some 4 MB for each partition.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of files in a micro-batch at most.
TRIGGER_BYTES = 64 << 30


def normalised(text: str = "text") -> Column:
    out = F.coalesce(F.col(text), F.lit(""))
    for space in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def _located(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, body, place, rank) of rows read from files: rank orders the rows of a group, the one that stays first, and holds the locator."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    out = rows.select(F.col(key).alias("doc_id"), normalised(text).alias("body"), F.coalesce(F.char_length(text), F.lit(0)).alias("length"), place.alias("place"))
    rank = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place.path", "place.row")
    return out.select("doc_id", "body", "place", rank.alias("rank"))


def _globbed(spark: SparkSession, path: str) -> str:
    """A path that a stream can read: folders and globs; a glob of one letter stands for a single file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return f"{path[:-1]}[{path[-1]}]" if where.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(where) else path


def run_stream(spark: SparkSession, path: str, folder: str, key: str, text: str, digest: Callable[[Column], Column], **options) -> None:
    """Brings entries and state in `folder` up to date with the files at `path`, and writes the entries of state that changed."""
    whole = spark.read.parquet(path).schema
    # only what is needed: a column of the table's own by the name of _metadata would hide the locator
    two = whole.fromJson({"type": "struct", "fields": [whole[c].jsonValue() for c in dict.fromkeys((key, text))]})
    source = spark.readStream.schema(two).options(**({"maxBytesPerTrigger": TRIGGER_BYTES} | options)).parquet(_globbed(spark, path))
    rows = _located(source, key, text)
    rows = rows.select(digest(F.col("body")).alias("digest"), sha256(F.col("body")).alias("sha"), "rank")
    rows.writeStream.format("parquet").option("path", f"{folder}/entries").option("checkpointLocation", f"{folder}/reading").trigger(availableNow=True).start().awaitTermination()

    entries = spark.readStream.schema(rows.schema).options(maxBytesPerTrigger=TRIGGER_BYTES).parquet(f"{folder}/entries")
    state = entries.groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("n"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")

    was = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
    """(digest, first, n): the entries as of the last batch."""
    schema = f"digest string, first struct<shorter: int, unnamed: boolean, doc_id: {id_type}, path: string, row: bigint>, n bigint, batch int"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changed")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).drop("batch")
    rows = spark.read.schema(schema).option("basePath", f"{folder}/changed").parquet(f"{folder}/changed")
    return rows.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("e")).select("digest", "e.first", "e.n")


def _broadcast(groups_: DataFrame) -> DataFrame:
    """groups_ to be joined: broadcast if its measured size is within the bound."""
    n, paths = groups_.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("first.path")), F.lit(0))).first()
    return small(groups_, 1, 256 * n + paths)


def dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, folder: str | None = None, **options) -> DataFrame:
    """One row for each row at `path`: doc_id, keep_id, group_size, kept, text_sha256."""
    folder = folder or fresh_path(spark, "exactdedup")
    run_stream(spark, path, folder, key, text, digest, **options)
    table = spark.read.parquet(path)
    table = spark.read.schema(table.select(*dict.fromkeys((key, text))).schema).parquet(path)
    several = materialize(groups(spark, folder, table.schema[key].dataType.simpleString()).where("n > 1"), "groups", few_files=True)
    entries = spark.read.parquet(f"{folder}/entries")
    found = entries.join(_broadcast(several), "digest", "left")
    # every hit on full bytes, read by its locator; the texts of one digest must be one text
    hits = found.where(F.col("n").isNotNull()).select("digest", F.struct("rank.path", "rank.row").alias("place"))
    n_hits = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = small(hits, n_hits, 384)
    texts = _located(table, key, text).join(hits, "place")
    collided = materialize(texts.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("digest"), "collided")
    if not collided.isEmpty():
        split = texts.join(collided, "digest", "left_semi").groupBy("digest", "body").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
        again = texts.join(collided, "digest", "left_semi").join(split, ["digest", "body"]).select(sha256(F.col("body")).alias("sha"), "rank", "first", "n")
        found = found.join(collided, "digest", "left_anti").select("sha", "rank", "first", "n").unionByName(again)
    alone = F.col("n").isNull()
    return found.select(
        F.col("rank.doc_id").alias("doc_id"),
        F.when(alone, F.col("rank.doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rank") == F.col("first"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet")


OP4_SQL = """
WITH d AS (SELECT doc_id, length(COALESCE(text, '')) AS n, regexp_replace(COALESCE(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, COUNT(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
"""
