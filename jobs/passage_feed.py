"""Passages of a growing document table: each run takes the files that are new, and cuts their documents into passages to be indexed.

    python -m jobs.passage_feed --config jobs/passage_feed.json

The source is a folder of Parquet files to which files are added (a crawl's, say). A document that comes again replaces what was there, and
one that comes without text, or with too little, has no passages any more. The stream's checkpoint knows which files have been read; a
batch's output has a folder of its own, so that a batch that broke off and is tried again writes the same anew:

    documents/batch=N/lang=…   the last version of each document of the batch, and how many rows it had there
    passages/batch=N/lang=…    its passages
    rejected/batch=N           rows without an id
    log/batch=N                one row: what was read and written

A document as it stands is that of its last batch. current() reads that: it looks up the few documents with more than one version, and
leaves their older passages out. Nothing is rewritten, so that a run costs what is new, not what is there.

In a batch, rows of one document are put in order by their files' times, then paths, then text, source and language. An empty language is none.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunk
from corpusloom.sources import files
from corpusloom.storage import fresh_path

from . import common

log = logging.getLogger("jobs.passage_feed")

#: Columns that are read of the source, whatever else it has.
SOURCE = ("doc_id", "text", "source", "lang")
PASSAGES = "doc_id {id}, source string, title string, section_idx int, part_idx int, section string, text string, batch long, lang string"
DOCUMENTS = "doc_id {id}, source string, text string, n_rows long, batch long, lang string"
LOG = "rows long, documents long, passages long, rejected long, batch long"


def _schema(spark: SparkSession, source: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in spark.read.parquet(source).schema if f.name in SOURCE}


def _write(rows: DataFrame, out: str, table: str, number: int) -> None:
    rows.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/{table}/batch={number}")


def _read(spark: SparkSession, out: str, table: str, schema: str, number: int | None = None) -> DataFrame:
    """A table, or one batch of it; languages are strings, whatever they look like."""
    rows = spark.read.schema(schema).option("basePath", f"{out}/{table}")
    return rows.parquet(f"{out}/{table}" + ("" if number is None else f"/batch={number}"))


def versions(rows: DataFrame) -> DataFrame:
    """The last version of each document of the rows, with the number of its rows. One aggregation: rows of a document collapse where they are read."""
    last = rows.groupBy("doc_id").agg(F.max(F.struct("_time", "_file", "text", "source", "lang")).alias("_last"), F.count("*").alias("n_rows"))
    return last.select("doc_id", "_last.source", "_last.text", "n_rows", "_last.lang")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP, files_per_batch: int = 256) -> DataFrame:
    """Takes all files that are new, in batches of `files_per_batch` at most, and returns the log of all batches there are."""
    chunk.check_sizes(size, overlap)
    types = _schema(spark, source)
    ids = types["doc_id"]

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select(*[F.col(c) if c in types else F.lit(None).cast("string").alias(c) for c in SOURCE], "_time", "_file")
        rows = rows.withColumn("lang", F.nullif("lang", F.lit("")))
        _write(versions(rows.where("doc_id is not null")), out, "documents", number)
        # passages are cut from what was written: the batch is read for its documents, and for its rows without an id
        docs = _read(batch.sparkSession, out, "documents", DOCUMENTS.format(id=ids), number)
        cut = chunk.chunks(docs.select("doc_id", F.col("source").alias("url"), F.col("source").alias("title"), "text", "lang"), size, overlap, keep=("lang",))
        _write(cut.withColumnRenamed("url", "source"), out, "passages", number)
        rows.where("doc_id is null").drop("_time").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        wrote = _counts(batch.sparkSession, out, number, ids)
        wrote.coalesce(1).write.mode("overwrite").json(f"{out}/log/batch={number}")
        log.info("batch %d: %s", number, wrote.first().asDict())

    stream = files.stream(spark, source, ", ".join(f"{k} {v}" for k, v in types.items()), files_per_batch)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"))
    log.info("reading what is new of %s into %s", source, out)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = runs(spark, out)
    log.info("%s has %d batches", out, done.count())
    return done


def _counts(spark: SparkSession, out: str, number: int, ids: str) -> DataFrame:
    docs = _read(spark, out, "documents", DOCUMENTS.format(id=ids), number).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), F.count("*").alias("documents"))
    passages = _read(spark, out, "passages", PASSAGES.format(id=ids), number).agg(F.count("*").alias("passages"))
    rejected = spark.read.parquet(f"{out}/rejected/batch={number}").agg(F.count("*").alias("rejected"))
    # three tables of one row
    return docs.crossJoin(passages).crossJoin(rejected).withColumn("rows", F.col("rows") + F.col("rejected"))


def runs(spark: SparkSession, out: str) -> DataFrame:
    """(rows, documents, passages, rejected, batch): one row a batch."""
    return spark.read.schema(LOG).json(f"{out}/log") if common.exists(spark, f"{out}/log") else spark.createDataFrame([], LOG)


def current(spark: SparkSession, out: str, table: str = "passages", ids: str = "long") -> DataFrame:
    """The table as it stands: of every document what its last batch wrote."""
    schema = {"passages": PASSAGES, "documents": DOCUMENTS}[table].format(id=ids)
    if not common.exists(spark, f"{out}/{table}"):
        return spark.createDataFrame([], schema)
    seen = _read(spark, out, "documents", DOCUMENTS.format(id=ids)).select("doc_id", "batch")
    last = seen.groupBy("doc_id").agg(F.max("batch").alias("last"), F.count("*").alias("n")).where("n > 1")
    old = seen.join(last, "doc_id").where("batch < last").select("doc_id", "batch")
    return _read(spark, out, table, schema).join(old, ["doc_id", "batch"], "left_anti")


def job1_passage_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the documents into a new folder: the second finds nothing new."""
    source, where = f"{sf_dir}/documents.parquet", fresh_path(spark, "job1")
    for _ in range(2):
        run(spark, source, f"{where}/out", f"{where}/checkpoint")
    rows = current(spark, f"{where}/out", ids=_schema(spark, source)["doc_id"])
    return rows.select("doc_id", "source", "lang", "section_idx", "part_idx", "section", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


#: Documents of the tables have no lines that begin as headings do, so a document is one section.
JOB1_SQL = f"""
WITH v AS (SELECT doc_id, text, source, NULLIF(lang, '') AS lang FROM documents WHERE doc_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY text DESC NULLS LAST, source DESC NULLS LAST, lang DESC NULLS LAST) = 1),
d AS (SELECT *, COALESCE(source, '') AS title, regexp_extract_all(text, '[^\\s]+') AS w FROM v WHERE length(text) >= {chunk.LEAST_CHARS}),
x AS (SELECT *, unnest(range(0, len(w), {chunk.SIZE - chunk.OVERLAP})) AS i FROM d WHERE len(w) > {chunk.SIZE}),
y AS (SELECT *, (i // {chunk.SIZE - chunk.OVERLAP})::INT AS part_idx, list_slice(w, i + 1, i + {chunk.SIZE}) AS part FROM x),
z AS (SELECT doc_id, source, lang, part_idx, 'part ' || (part_idx + 1) AS section, title || ' (part ' || (part_idx + 1) || ')' || chr(10) || array_to_string(part, ' ') AS t FROM y WHERE len(part) >= {chunk.LEAST_WORDS}
      UNION ALL SELECT doc_id, source, lang, 0, '', title || chr(10) || text FROM d WHERE len(w) <= {chunk.SIZE})
SELECT doc_id, source, lang, 0 AS section_idx, part_idx, section, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM z
"""


if __name__ == "__main__":
    common.main("passage_feed", run, ("source", "out", "checkpoint"))
