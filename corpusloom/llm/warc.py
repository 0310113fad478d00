"""Operator 5, WARC archives with revisit records.

Headers (page, URL, digest, length; no payloads) are shuffled by payload digest. Of equal payloads of at least
REVISIT_BYTES the record with the largest page_id is the response; the others become revisit records
that refer to it. Each record is compressed as gzip members of its own, so that it can be sought, and one of less than 16 MiB is one member.
The archives are written by Spark's text sink, so they are committed like any Spark output and survive lost executors: the
sink's separator is the zero byte in which these members end. A file gets records up to FILE_BYTES. Reading goes through the files
record by record, a piece at a time, by Content-Length, checks the digests of the payloads, and joins revisits to the responses that they name.

Payloads aren't shuffled while the digests that occur more than once fit a broadcast. Rows that repeat entirely are written to the shared
folder with a place that tells them apart, so that one of them is the response and every record has an id of its own.

Defined cases: null html is an empty payload; very long html is a file of its own; null urls have no target URI; a null page_id is smaller
than any other; of one page_id with several urls the largest url is the response; line breaks in a url are dropped; extra columns, whatever
their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes in an archive file at most, unless it is one record.
FILE_BYTES = 64 << 20
#: Bytes that a gzip member holds at most: the last byte of its length, which ends it, is zero.
MEMBER_BYTES = (1 << 24) - 1
#: Bytes of a payload that are read at once.
PIECE = 1 << 20
#: Fixed value: the profile of revisit records with an identical payload (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of the records: the operator has no clock of its own, so that reruns write the same.
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n"


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html")).withColumns({"digest": F.sha1(html.cast("binary")), "size": F.octet_length(html).cast("long")})


KEY = ["page_id", "url", "digest"]


def _placed(rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with a place: -1, but numbers of their own for rows that repeat entirely; and heads with the least place of each. heads: KEY, size, n."""
    again = materialize(heads.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in KEY]), "again", few_files=True)
    n = again.count()
    alone = F.lit(-1).cast("long")
    if not n:
        return rows.withColumn("place", alone), heads.withColumn("place", alone)
    same = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page_id")) & F.col("url").eqNullSafe(F.col("_url"))
    again = small(again, n, 192)
    placed = materialize(rows.join(again, same, "left_semi").withColumn("place", F.monotonically_increasing_id()), "placed")
    least = heads.where("n = 1").withColumn("place", alone).unionByName(placed.groupBy(*KEY, "size").agg(F.count("*").alias("n"), F.min("place").alias("place")))
    return rows.join(again, same, "left_anti").withColumn("place", alone).unionByName(placed), least


def repeated(heads: DataFrame) -> DataFrame:
    """(digest, best{page_id, url, place}) of the payloads that are stored once; best is the response."""
    by = heads.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "url", "place")).alias("best"), F.sum("n").alias("copies"))
    return by.where("copies > 1").select("digest", "best")


def _record_id(page_id: Column, url: Column, digest: Column, place: Column) -> Column:
    hexes = F.md5(F.concat_ws("\x1f", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("null")), digest, place.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def records(pages: DataFrame) -> DataFrame:
    """One row for each page: `record`, the whole WARC record without its closing blank line."""
    rows = _payloads(pages)
    heads = materialize(rows.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "heads")
    rows, heads = _placed(rows, heads)
    dups = materialize(repeated(heads), "payloads")
    rows = rows.join(small(dups, dups.count(), 256), "digest", "left")
    best = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url")) & (F.col("place") == F.col("best.place"))
    rows = rows.withColumn("revisit", F.col("best").isNotNull() & ~best)
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(BREAK))
    clean = lambda url: F.regexp_replace(url, "[\\r\\n]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(BREAK + BREAK))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    origin = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("best.page_id"), F.col("best.url"), F.col("digest"), F.col("best.place")), F.lit(">"))),
        F.coalesce(line("WARC-Refers-To-Target-URI", clean(F.col("best.url"))), F.lit("")),
        line("WARC-Refers-To-Date", F.lit(DATE)),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("place")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", clean(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), origin).otherwise(F.lit("")),
        F.coalesce(line("Page-Id", clean(F.col("page_id").cast("string"))), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
    )
    return rows.select(F.concat(head, block).alias("record"))


def members(record: bytes) -> bytes:
    """The record, compressed, without the last byte, which is zero."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(wbits=31)
        out += [packer.compress(record[at : at + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)[:-1]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    volume = filled = 0

    def out(rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], ["value", "volume"])

    for batch in batches:
        rows, size = [], 0
        for record in batch.column("record").cast(pa.binary()):
            data = members(record.as_py() + BREAK.encode() * 2)
            if filled and filled + len(data) > FILE_BYTES:
                volume, filled = volume + 1, 0
            filled += len(data) + 1
            rows.append((data, volume))
            size += len(data)
            if size > 4 * PIECE:
                yield out(rows)
                rows, size = [], 0
        yield out(rows)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes the pages as compressed WARC files, path/volume=N/part-…; a task's next volume begins where one is full."""
    packed = records(pages).mapInArrow(_packed, "value binary, volume int")
    packed.select(F.col("value").cast("string"), "volume").write.partitionBy("volume").option("lineSep", "\0").text(path)


def headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The headers of the next record of an uncompressed WARC stream by lower-case name; None at its end. Its block follows."""
    line = stream.readline()
    while line and not line.strip():
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head = {}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.lower()] = value.strip()
    return head


def payload(stream: io.BufferedIOBase, left: int) -> tuple[int, str]:
    """Size and SHA-1 of the payload of the HTTP message in the next `left` bytes, read by pieces."""
    while left:
        line = stream.readline(left)
        left -= len(line)
        if line in (b"\r\n", b""):
            break
    size, digest = left, hashlib.sha1()
    while left:
        piece = stream.read(min(left, PIECE))
        if not piece:
            raise ValueError("a record ends before its Content-Length")
        digest.update(piece)
        left -= len(piece)
    return size, digest.hexdigest()


COLUMNS = "page_id string, url string, record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in COLUMNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), PIECE)
            while (r := headers(stream)) is not None:
                size, found = payload(stream, int(r["content-length"]))
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                whole = r["warc-type"] == "response"
                if whole and found != digest:
                    raise ValueError(f"payload of {r['warc-record-id']} doesn't match its digest")
                rows.append((r.get("page-id"), r.get("warc-target-uri"), r["warc-type"], r["warc-record-id"], r.get("warc-refers-to"), digest, size if whole else None))
                if len(rows) == 5000:
                    yield out(rows)
                    rows = []
            yield out(rows)


def read_archives(spark, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to): revisits have their response's page_id and size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    index = materialize(files.mapInArrow(_index, COLUMNS).withColumn("page_id", F.col("page_id").cast(id_type)), "cdx")
    responses = index.where("record_type = 'response'")
    origins = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("origin"), F.col("payload_bytes").alias("origin_bytes"), F.col("payload_digest").alias("origin_digest"))
    revisits = index.where("record_type = 'revisit'").drop("payload_bytes").join(origins, "refers_to").where("payload_digest = origin_digest")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type"]
    return responses.select(*columns, F.lit(None).cast(id_type).alias("refers_to")).union(revisits.withColumnRenamed("origin_bytes", "payload_bytes").select(*columns, "origin"))


def op5_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, MAX(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM d
"""
