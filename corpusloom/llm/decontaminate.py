"""Operator 10, benchmark decontamination: size-partitioned MinHash containment search.

A document holds a benchmark item if it has at least 0.8 of the item's distinct five-word
shingles. Items are partitioned by size, in powers of two. In a partition of items with at most u
shingles, each is represented by its MinHash sketch of the k = floor(0.2 u) + 1 smallest shingle
hashes. A document that holds 0.8 of the item lacks at most floor(0.2 u) of its shingles, so it
must share a sketch value, however long it is: the search has no false negatives, where banded
MinHash of a whole long document would have many. Candidates are verified by exact
containment of the shingles' words.

The items are the stated query set. Up to BLOCK_BYTES of them are broadcast, and one pass over the documents without a shuffle
finds and verifies. More stay a table: a bitmap of their sketch values, of a fixed size, is broadcast; one pass over the documents
gives the shingle hashes that pass it, a join on the sketch values the candidates; only the candidates' texts are read again, to be
verified. That is two passes however many items there are. Nothing is collected from the documents.

Words are maximal runs of letters, numbers, marks and underscores of the text in lower case (final sigma as sigma, no dot above a small i).
An item of fewer than five words has one shingle, all its words; it is found as that run of words.

Defined cases: null and empty texts hold nothing, and items without words are held by nothing; very long texts are read whole; ids
may be of any type, null included; repeated rows, of either side, give repeated results only if their ids differ; extra columns do no
harm, whatever their names; without items nothing is held. There are no ties: an item is held or not, and a document may
hold several.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of item text that are collected and broadcast at most.
BLOCK_BYTES = 2 << 20
#: Log2 of the size of the bitmap that is asked before the sketch values: of broadcast items, and of a table of items (16 MiB).
MASK_BITS = 20
TABLE_BITS = 27


_plain = re.compile(r"\w+").findall
#: The first mark is U+0300.
_beyond = re.compile("[^\x00-\u02ff]").search


@cache
def _pattern() -> re.Pattern[str]:
    r"""[\p{L}\p{N}\p{M}_]+ for the standard library, whose \w lacks the marks."""
    marks = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
    return re.compile(f"[\\w{marks}]+")


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    if low.isascii() or not _beyond(low):  # no marks, no sigma
        return _plain(low)
    return _pattern().findall(low.replace("ς", "σ").replace("i\u0307", "i"))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _hashes_of(words: list[str], cache_: _Hashes) -> np.ndarray:
    return np.fromiter(map(cache_.__getitem__, words), np.uint64, len(words))


def sketch(words: list[str], hashes: np.ndarray) -> tuple[int, set[tuple[str, ...]], np.ndarray]:
    """The width of an item's shingles, the shingles, and its MinHash sketch."""
    width = min(SHINGLE, len(words))
    runs = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    upper = 1 << (len(runs) - 1).bit_length()
    k = int((1 - CONTAINMENT) * upper + 1e-9) + 1
    return width, runs, np.unique(_rolling(hashes, width))[:k]


def shared(words: list[str], by_width: dict[int, set], runs: set[tuple[str, ...]], width: int) -> int | None:
    """How many of an item's shingles the words have, if that is enough of them."""
    if width not in by_width:
        by_width[width] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    n = len(runs & by_width[width])
    return n if n >= CONTAINMENT * len(runs) - 1e-9 else None


class Index:
    """Items to broadcast: sketch values to items, and each item's shingles."""

    def __init__(self, texts: list[str]):
        seen = _Hashes()
        self.shingles: dict[int, tuple[int, set[tuple[str, ...]]]] = {}
        by_width: dict[int, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                width, runs, values = sketch(words, _hashes_of(words, seen))
                by_width.setdefault(width, []).extend((int(h), i) for h in values)
                self.shingles[i] = width, runs
        self.tables = []
        for width, pairs in sorted(by_width.items()):
            pairs.sort()
            keys = np.array([p[0] for p in pairs], np.uint64)
            mask = np.zeros(1 << MASK_BITS, bool)
            mask[(keys >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
            self.tables.append((width, keys, np.array([p[1] for p in pairs]), mask))

    def search(self, text: str | None, cache_: _Hashes) -> list[tuple[int, int, int]]:
        """(number of the item, shared shingles, item's shingles) of all items that the text holds."""
        words = words_of(text)
        hashes = _hashes_of(words, cache_)
        held, by_width = [], {}
        for width, keys, items, mask in self.tables:
            runs = _rolling(hashes, width)
            runs = runs[mask[(runs >> np.uint64(64 - MASK_BITS)).astype(np.int64)]]
            if not len(runs):
                continue
            lo, hi = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
            for i in sorted({int(i) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for i in items[a:b]}):
                n = shared(words, by_width, self.shingles[i][1], width)
                if n is not None:
                    held.append((i, n, len(self.shingles[i][1])))
        return held


def _items(items: DataFrame) -> tuple[DataFrame, bool]:
    """(item_id, text) of the items, each once; and whether they may be broadcast."""
    rows = items.select("item_id", F.col("text").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return rows, total <= BLOCK_BYTES


def _measured(rows: DataFrame) -> DataFrame:
    """One row for a document and item; where ids repeat, the fullest."""
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared", "n_shingles")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_shingles", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"))


def _by_broadcast(rows: DataFrame, items: DataFrame) -> DataFrame:
    got = items.toArrow()
    shared_index = rows.sparkSession.sparkContext.broadcast((Index(got.column("text").to_pylist()), got.column("item_id").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_ = _Hashes()
        index, ids = shared_index.value
        for batch in batches:
            found = [(i, *hit) for i, value in enumerate(batch.column("text")) for hit in index.search(value.as_py(), cache_)]
            at, item, n, size = (pa.array([f[j] for f in found], pa.int64()) for j in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), ids.take(item), n, size], ["doc_id", "item_id", "n_shared", "n_shingles"])

    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_shingles long")


def _spots(hashes: np.ndarray, width: int) -> np.ndarray:
    return ((hashes ^ np.uint64(width * 0x9E3779B9)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _by_table(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The same for items of any number: two passes over rows (doc_id, text)."""
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_ = _Hashes()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                if words:
                    width, _, values = sketch(words, _hashes_of(words, cache_))
                    out.append((np.full(len(values), item), np.full(len(values), width), values.view(np.int64), _spots(values, width)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "width", "hash", "spot"])

    wanted = materialize(items.mapInArrow(sketches, "item long, width long, hash long, spot long"), "sketches")
    parts = wanted.groupBy(F.call_function("bitmap_bucket_number", F.col("spot") + 1).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("spot") + 1)).alias("bits"))
    bitmap = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
    for r in parts.collect():  # 4 KiB each, the bitmap's size in all
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bitmap[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    known = rows.sparkSession.sparkContext.broadcast((bitmap, [r.width for r in wanted.select("width").distinct().collect()]))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_ = _Hashes()
        bits, widths = known.value
        for batch in batches:
            out = []
            for doc, content, text in zip(batch.column("doc").to_pylist(), batch.column("content").to_pylist(), batch.column("text"), strict=True):
                hashes = _hashes_of(words_of(text.as_py()), cache_)
                for width in widths:
                    runs = np.unique(_rolling(hashes, width))
                    spots = _spots(runs, width)
                    runs = runs[(bits[spots >> 3] >> (spots & 7)) & 1 == 1]
                    if len(runs):
                        out.append((np.full(len(runs), doc), np.full(len(runs), content), np.full(len(runs), width), runs.view(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "content", "width", "hash"])

    rows = rows.withColumns({"doc": F.xxhash64("doc_id"), "content": F.xxhash64("text")})
    found = rows.select("doc", "content", "text").mapInArrow(hits, "doc long, content long, width long, hash long")
    pairs = materialize(found.join(wanted.drop("spot"), ["width", "hash"]).select("doc", "content", "item").distinct(), "candidates")
    lists = pairs.join(items.select("item", F.col("text").alias("wanted")), "item").groupBy("doc", "content").agg(F.collect_list(F.struct("item", "wanted")).alias("items"))
    docs = pairs.select("doc", "content").distinct()
    near = rows.join(small(docs, docs.count()), ["doc", "content"], "left_semi").join(lists, ["doc", "content"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (text, listed) in enumerate(zip(batch.column("text"), batch.column("items"), strict=True)):
                words, by_width = words_of(text.as_py()), {}
                for x in listed.as_py():
                    own = words_of(x["wanted"])
                    width = min(SHINGLE, len(own))
                    runs = {tuple(own[j : j + width]) for j in range(len(own) - width + 1)}
                    n = shared(words, by_width, runs, width)
                    if n is not None:
                        out.append((i, x["item"], n, len(runs)))
            at, item, n, size = (pa.array([f[j] for f in out], pa.int64()) for j in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), item, n, size], ["doc_id", "item", "n_shared", "n_shingles"])

    held = near.select("doc_id", "text", "items").mapInArrow(verify, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item long, n_shared long, n_shingles long")
    return held.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "n_shared", "n_shingles")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for each document and each item that it holds."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    items, few = _items(items)
    return _measured(_by_broadcast(rows, items) if few else _by_table(rows, items))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item. No shuffle of texts where the items, or else the contents that hold one, may be broadcast."""
    items, few = _items(items)
    if not few:
        # here a row's text is its identity: equal texts hold the same
        rows = docs.select(F.xxhash64(F.col(text)).alias("doc_id"), F.col(text).alias("text"))
        gone = materialize(_by_table(rows, items).select(F.col("doc_id").alias("_loom_content")).distinct(), "leaks")
        return docs.join(small(gone, gone.count()), F.xxhash64(F.col(text)) == F.col("_loom_content"), "left_anti")
    shared_index = docs.sparkSession.sparkContext.broadcast(Index(items.toArrow().column("text").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_ = _Hashes()
        for batch in batches:
            yield batch.filter(pa.array([not shared_index.value.search(t.as_py(), cache_) for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by joining all shingles, for small tables.
OP10_SQL = """
WITH i0 AS (SELECT DISTINCT item_id, regexp_extract_all(replace(replace(lower(text), 'ς', 'σ'), 'i' || chr(775), 'i'), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' '))) AS s FROM i0 WHERE len(w) > 0),
n AS (SELECT item_id, COUNT(*)::BIGINT AS n_shingles FROM i GROUP BY item_id),
d0 AS (SELECT doc_id, regexp_extract_all(replace(replace(lower(text), 'ς', 'σ'), 'i' || chr(775), 'i'), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM i),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(list_slice(w, p, p + k - 1), ' '))) AS s FROM d0, ks WHERE len(w) >= k),
p AS (SELECT d.doc_id, i.item_id, COUNT(*)::BIGINT AS n_shared FROM d JOIN i ON d.s = i.s AND d.k = i.k GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM p JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""
