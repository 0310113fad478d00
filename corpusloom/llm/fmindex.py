"""Operator 8, substring deduplication over words with an FM-index for each shard.

Windows of SPAN words are dealt out by their anchor gram (see windows.py), so that a shard holds all
contexts in which one of its windows can occur, and the number of shards grows with the input, not the work of each
document. Of a shard's contexts a task builds an FM-index: the Burrows-Wheeler transform of the word numbers,
from suffixes ordered by prefix doubling, in a wavelet tree of packed bits with rank counts. The contexts then stream through
backward search, many at a time, which gives matching statistics: the longest run of words ending at a place that
occurs twice. Runs of SPAN words or more are reported. The whole-context matches that anchors settle before are not searched again.
A shard that is too large for a task is split by the next words of its windows, pass by pass, until each part's index is small; equal windows
stay together in a part.

A word is removed if a window that covers it occurs anywhere else, in the same or another document.

Defined cases: null, empty and blank texts have no words; documents shorter than SPAN words lose none; very long ones are hashed in
parts, with the same result; ids may be of any type that has an order, null included; a repeated row is another document; an empty table gives an
empty result; extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import WORD_PATTERN
from .suffixarray import merged
from .windows import Shape, join_spans, repeats, with_uid

SPAN = 35
SHAPE = Shape(SPAN, 16, hot=500, digits=(6, 29))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def tokens(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def cut(text: bytes):
    words = text.split()
    return lambda start, end: b" ".join(words[start:end])


def split(content: bytes) -> list[tuple[bytes, ...]]:
    """The digits of each window: its words by some at a time, each closed by a space."""
    words = [w + b" " for w in content.split()]
    ends = list(accumulate(SHAPE.digits))
    return [tuple(b"".join(words[i + e - n : i + e]) for n, e in zip(SHAPE.digits, ends, strict=True)) for i in range(len(words) - SPAN + 1)]


class WaveletTree:
    """Rank of a symbol in a sequence, by levels of packed bits, the highest bit first; zeros of a level go before its ones."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64)
            self.levels.append((bit, words, before, int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place `upto`, plus where the symbol's run begins in the lowest level."""
        at = upto
        for bit, words, before, zeros in self.levels:
            block = at >> 6
            ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> bit & 1 == 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Of sequences of symbols from 1 on, laid end to end with a 0 after each. Counts patterns of up to `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        largest = int(text.max(initial=0))
        rank, width = text.astype(np.int64), 1
        while width < depth:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = np.diff(key[order]) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            width *= 2
            if n and rank[order[-1]] == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        self.size = n
        self.tree = WaveletTree(text[order - 1], largest)
        counts = np.bincount(text, minlength=largest + 1)
        symbols = np.arange(largest + 1)
        # of each symbol: its first suffix, less where its run begins in the tree
        self.shift = np.cumsum(counts) - counts - self.tree.rank(symbols, np.zeros(largest + 1, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with the symbol and then a suffix of [lo, hi): one step of backward search."""
        ends = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return ends[: len(symbol)], ends[len(symbol) :]


def repeated_runs(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(sequence, start, length) of runs of at least `span` symbols that occur twice, for sequences text[begin:end] of the index.

    From the end of each sequence on, a run is extended to the left while it occurs twice. A run that is
    long enough is reported, and the next one searched must begin before it; after a shorter one the end moves by one.
    """
    lane = np.flatnonzero(end - begin >= span)
    begin, stop = begin[lane], end[lane].copy()
    length = np.zeros(len(lane), np.int64)
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64)
    found = []
    while len(lane):
        can = stop - length > begin
        new_lo, new_hi = index.extend(text[np.where(can, stop - length - 1, begin)], lo, hi)
        good = can & (new_hi - new_lo >= 2)
        lo, hi, length = np.where(good, new_lo, lo), np.where(good, new_hi, hi), length + good
        over = ~good
        if over.any():
            hit = over & (length >= span)
            if hit.any():
                found.append((lane[hit], (stop - length - begin)[hit], length[hit]))
            stop = np.where(over, np.where(hit, stop - length + span - 1, stop - 1), stop)
            length, lo, hi = np.where(over, 0, length), np.where(over, 0, lo), np.where(over, index.size, hi)
            more = stop - begin >= span
            if not more.all():
                lane, begin, stop, length, lo, hi = (x[more] for x in (lane, begin, stop, length, lo, hi))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def solve(gram: np.ndarray, uid: np.ndarray, start: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows that occur twice in the contexts."""
    numbers: dict[bytes, int] = {}
    sequences = [[numbers.setdefault(w, len(numbers) + 1) for w in c.split()] + [0] for c in content]
    sizes = np.array([len(s) for s in sequences])
    text = np.fromiter((x for s in sequences for x in s), np.int64, int(sizes.sum()))
    end = np.cumsum(sizes) - 1
    which, first, length = repeated_runs(FMIndex(text, 2 * SPAN), text, end - sizes + 1, end)
    return join_spans(uid[which], start[which] + first, length)


def removed(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text, spans) of every document, in words; spans null if nothing is removed."""
    return docs.join(repeats(docs, SHAPE, tokens, cut, split, solve, every=True), "uid", "left")


def _cut(batches):
    for batch in batches:
        size, gone, digest = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans"), strict=True):
            words = (text.as_py() or b"").split()
            found = merged([(s["start"], s["length"]) for s in spans.as_py() or ()])
            kept, at = [], 0
            for s, e in found:
                kept += words[at:s]
                at = e
            kept += words[at:]
            size.append(len(words))
            gone.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of (doc_id, text)."""
    found = removed(with_uid(docs)).select("doc_id", "text", "spans")
    return found.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def op8_fm_index(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by counting all windows, for small tables.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD_PATTERN}') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - {SPAN - 2})) AS i, unnest(list_transform(range(1, len(w) - {SPAN - 2}), lambda p: array_to_string(list_slice(w, p, p + {SPAN - 1}), ' '))) AS s FROM d WHERE len(w) >= {SPAN}),
r AS (SELECT doc_id, i FROM x QUALIFY COUNT(*) OVER (PARTITION BY s) > 1),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
m AS (SELECT t.doc_id, t.i, t.word, COUNT(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.i = r.i),
k AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(k.n_removed, 0)::BIGINT AS n_removed, sha256(COALESCE(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
