"""JSON Lines, text and HTML sources and sinks.

Readers keep what their callers rely on: tolerant ones skip blank and malformed lines, strict ones fail on them; text
readers keep line numbers, as identity is by position there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENT, MANIFEST, QA, SQUAD

#: Fixed value: what ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def place():
    """Where a line of text files is: files in the order in which they were written, then the place in the file, whichever task reads it."""
    return F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_tolerant(spark: SparkSession, path: str, schema: str = DOCUMENT, required: str = "url", placed: str | None = None) -> DataFrame:
    """Rows of the lines that parse and have the required field; with a column `placed` that orders them as the lines are."""
    row = F.from_json(F.trim("value"), schema, {"mode": "PERMISSIVE"})
    lines = spark.read.text(path)
    kept = lines.select("value", place().alias("_at")) if placed else lines
    out = kept.where(F.trim("value") != "").withColumn("r", row).where(F.col(f"r.{required}").isNotNull())
    return out.select("r.*", F.col("_at").alias(placed)) if placed else out.select("r.*")


def read_strict(spark: SparkSession, path: str, schema: str = QA) -> DataFrame:
    """Rows of all lines; fails on one that doesn't parse. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str, column: str, strip: bool = False) -> DataFrame:
    """(pos, column): the lines of one file with their numbers from 0. The file is read whole, as its order is its key. All of Unicode's line ends end one."""
    lines = F.split(F.regexp_replace(F.col("value"), f"(?:{LINE_END})\\z", ""), LINE_END)
    rows = spark.read.text(path, wholetext=True).where("value <> ''").select(F.posexplode(lines).alias("pos", column))
    value = F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "") if strip else F.col(column)
    return rows.select(F.col("pos").cast("long"), value.alias(column))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_tolerant(spark, path, MANIFEST, "url")


def read_pages(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(url, filename, timestamp, html) of the manifest's files that exist; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    html = F.call_function("make_valid_utf8", F.col("content").cast("string"))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), html.alias("html"))
    return manifest.join(named, "filename").select("url", "filename", "timestamp", "html")


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    """(id, answers) of the questions of a SQuAD file."""
    data = spark.read.schema(SQUAD).option("multiLine", True).json(path)
    qas = data.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select(F.explode("p.qas").alias("q"))
    return qas.select("q.id", F.col("q.answers.text").alias("answers"))


def read_squad_version(spark: SparkSession, path: str) -> str | None:
    row = spark.read.schema(SQUAD).option("multiLine", True).json(path).select("version").first()
    return row[0] if row else None


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction) of a file with one JSON object from id to answer."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "prediction"))


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log. With a column `batch`, the number of their batch, they are in order whatever times the store gives to files."""
    rows.write.mode("append").json(path)


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after the last batch of a log; rows without one come before all."""
    return (spark.read.schema("batch long").json(path).agg(F.max("batch")).first()[0] or 0) + 1


def logged_keys(spark: SparkSession, path: str, schema: str, key: str = "url") -> DataFrame:
    """Distinct keys of a log."""
    return read_tolerant(spark, path, schema, key).select(key).distinct()


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_lines(rows: DataFrame, path: str, column: str, order: str = "pos") -> None:
    """One line a row in order, in one file: what a submission format asks for."""
    rows.orderBy(order).select(F.coalesce(F.col(column), F.lit("")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_pages(rows: DataFrame, path: str) -> None:
    """Raw pages as a table by URL; small files of one page each don't suit a cluster's file system."""
    rows.write.mode("append").parquet(path)
