"""Operator 6, suffix-array deduplication by a depth-limited radix sort over bytes.

Suffixes are ordered only as far as the threshold of SPAN bytes: what is equal to that depth is a repeated window, and
nothing needs a deeper order. The first digit is the window's anchor gram, by which suffixes are dealt out to tasks (see
windows.py: one row stands for the neighbouring suffixes of an anchor, as a shuffle of every suffix would take some 25
times the input). Suffixes of which the whole context is the same are settled together; the rest are sorted
by passes over 8 bytes at a time, most significant first. A suffix alone in its group leaves; groups that last through SPAN bytes are
exactly the repeated windows. Groups of more suffixes than a task should sort are dealt out again by the next bytes, pass by pass.

A byte is removed if a repeated window that isn't the first of its group (smallest document, then start) covers it.

Defined cases: null and empty texts have no bytes; texts shorter than SPAN lose none; very long ones are hashed in parts, with the
same result; ids may be of any type that has an order; repeated rows and null ids are ordered by id (null last), then by a hash: the
first stays whole; an empty table gives an empty result; extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import Shape, join_spans, repeats, with_uid

SPAN = 100
DIGIT = 8
#: The passes over groups that are too large for a task take 16 bytes, then the rest; those in a task take DIGIT bytes.
SHAPE = Shape(SPAN, 32, hot=1000, digits=(16, 84))
#: Hashes of the byte values, of no meaning but that they are fixed.
BYTES = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def tokens(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def cut(text: bytes):
    return lambda start, end: text[start:end]


def split(content: bytes) -> list[tuple[bytes, ...]]:
    """The digits of each window, most significant first."""
    ends = list(accumulate(SHAPE.digits))
    return [tuple(content[i + e - n : i + e] for n, e in zip(SHAPE.digits, ends, strict=True)) for i in range(len(content) - SPAN + 1)]


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Indices into `at` of the windows data[at:at + span] that occur more than once in their group, and the number of each one's class.

    group must be ascending. Within a class the indices ascend.
    """
    digits = np.ndarray(max(0, len(data) - DIGIT + 1), ">u8", np.ascontiguousarray(data), strides=(1,))
    alive = np.arange(len(at))
    for depth in [*range(0, span - DIGIT, DIGIT), span - DIGIT]:
        digit = digits[at[alive] + depth].astype(np.uint64)
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.ones(len(alive), bool)
        new[1:] = (np.diff(group) != 0) | (digit[1:] != digit[:-1])
        group = np.cumsum(new)
        sizes = np.bincount(group)
        several = sizes[group] > 1
        alive, group = alive[several], group[several]
        if not len(alive):
            break
    return alive, group


def solve(gram: np.ndarray, uid: np.ndarray, start: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows that aren't the first of their class. The contexts are in order of gram, uid, start."""
    data = np.frombuffer(b"".join(content), np.uint8)
    sizes = np.array([len(c) for c in content])
    n = sizes - SPAN + 1
    of = np.repeat(np.arange(len(content)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[of] + within
    group = np.cumsum(np.concatenate([[0], np.diff(gram) != 0]))[of]
    alive, classes = equal_windows(data, at, group)
    first = np.ones(len(alive), bool)
    first[1:] = np.diff(classes) != 0
    later = alive[~first]
    return join_spans(uid[of[later]], start[of[later]] + within[later], np.full(len(later), SPAN))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of spans (start, length)."""
    runs: list[list[int]] = []
    for start, end in sorted((s, s + n) for s, n in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(s, e) for s, e in runs]


def removed(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text, spans) of every document; spans null if nothing is removed."""
    return docs.join(repeats(docs, SHAPE, tokens, cut, split, solve, every=False), "uid", "left")


def _cut(batches):
    for batch in batches:
        size, gone, runs, digest = [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            data = text.as_py() or b""
            found = merged([(s["start"], s["length"]) for s in spans.as_py() or ()])
            kept, at = hashlib.sha256(), 0
            for s, e in found:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            size.append(len(data))
            gone.append(sum(e - s for s, e in found))
            runs.append(len(found))
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text)."""
    found = removed(with_uid(docs)).select("doc_id", "text", "spans")
    return found.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_array(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by ranking all windows of hexadecimal text, for small tables.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, strlen(COALESCE(text, ''))::BIGINT AS n FROM documents),
t AS (SELECT doc_id, h, n, unnest(range(n)) AS i FROM d),
x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i + {SPAN} <= n THEN md5(substr(h, 2 * i + 1, {2 * SPAN})) END AS s FROM t),
r AS (SELECT doc_id, i, b, s IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM x),
m AS (SELECT doc_id, i, b, COUNT(*) FILTER (again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM r),
e AS (SELECT *, gone AND NOT COALESCE(LAG(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM m),
k AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, COUNT(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, COALESCE(k.n_removed, 0)::BIGINT AS n_removed, COALESCE(k.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
