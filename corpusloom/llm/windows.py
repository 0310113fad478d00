"""Repeated windows of tokens, for the suffix-array and FM-index operators.

A window is `span` consecutive tokens of one document. To find all windows that occur twice without
shuffling every position, each window is assigned to its anchor: the position in it of the gram (run of `gram`
tokens) with the smallest hash. Equal windows have equal anchors at equal offsets, so they meet in the
group of the anchor's gram. Neighbouring windows mostly share an anchor; one row stands for all of them.

1. `anchor_rows` makes a row for each anchor: hash of the gram, hash of its context (the tokens of all its windows),
   and the range of its windows. Anchors with equal contexts are collapsed within a block of input before the shuffle, so
   that a group with a third of all rows sends one row from each block.
2. `settle` reads the anchors sorted by gram and context. Equal contexts (128 bits of hash) are equal windows throughout: they
   are settled there. Anchors whose gram is shared by different contexts are open: their contexts must be compared.
3. `open_contexts` fetches the tokens of the open anchors, and a solver given by the operator compares the windows of each gram's
   contexts.
4. Grams with more open contexts than Shape.hot are split first (`refined`): their windows are regrouped by their next tokens, pass by
   pass, most significant first. Windows alone in their group leave, groups of up to a quarter of Shape.hot go to the solver, larger ones to the next pass;
   with the last pass a group's windows are equal throughout, and counted. No task gets more than that of a group.
5. `repeats` gathers the spans found, by document.

Positions and identities fit 64-bit integers; texts are UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, materialize, numbered, small

U = np.uint64
#: Tokens that are hashed at once; bounds the memory of the arrays for very long texts.
CHUNK = 1 << 20
POSITION_BITS = 22
ANCHOR_FIELDS = ["gram", "context", "uid", "place"]
ANCHOR_SCHEMA = "gram long, context long, uid long, place long"

@dataclass(frozen=True)
class Shape:
    """span: tokens in a window; gram: tokens in an anchor's gram, a power of two; hot: contexts or windows of one group that one task compares at most; digits: tokens by which the passes over larger groups regroup, span in all."""

    span: int
    gram: int
    hot: int
    digits: tuple[int, ...]


def mix(x: np.ndarray) -> np.ndarray:
    x = x * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(32))


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` tokens from each position on, by doubling."""
    out, width = mix(tokens), 1
    while width < gram:
        out = mix(out[:-width] * U(0xD6E8FEB86659FD93) + (out[width:] ^ U(0xA0761D6478BD642F + width)))
        width *= 2
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchor_ranges(tokens: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end (ends: where each one ends): for each anchor its first window, number of windows, lead (from that window to the anchor), gram hash and context hash."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, U),) * 2
    if len(tokens) < shape.span:
        return none
    hashes = gram_hashes(tokens, shape.gram)
    order = (hashes & ~U((1 << POSITION_BITS) - 1)) | np.arange(len(hashes), dtype=U)
    least = (sliding_min(order, shape.span - shape.gram + 1) & U((1 << POSITION_BITS) - 1)).astype(np.int64)
    starts = np.arange(len(least))
    inside = np.ones(len(least), bool)
    for e in ends[:-1]:  # windows that cross the end of a document
        inside[max(0, e - shape.span + 1) : e] = False
    starts, least = starts[inside], least[inside]
    if not len(starts):
        return none
    new = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(starts) != 1)]))
    first, n = starts[new], np.diff(np.append(new, len(starts)))
    at = least[new]
    length = n - 1 + shape.span
    context = mix((length * 4096 + (at - first)).astype(U))
    for i in range(-(-(2 * shape.span - shape.gram) // shape.gram)):
        context = mix((context ^ hashes[first + np.minimum(i * shape.gram, length - shape.gram)]) * U(0xD6E8FEB86659FD93) + U(i))
    return first, n, at - first, hashes[at], context


class Block:
    """Anchors of documents that are added one by one, and their collapse."""

    def __init__(self, shape: Shape):
        self.shape, self.parts, self.waiting, self.size = shape, [], [], 0

    def add(self, uid: int, tokens: np.ndarray) -> None:
        """tokens: 64-bit hashes."""
        for at in range(0, max(1, len(tokens) - self.shape.span + 1), CHUNK):
            part = tokens[at : at + CHUNK + self.shape.span - 1]
            if len(part) >= self.shape.span:
                self.waiting.append((uid, at, part))
                self.size += len(part)
            if self.size >= CHUNK:
                self._flush()

    def _flush(self) -> None:
        if not self.waiting:
            return
        lengths = np.array([len(t) for _, _, t in self.waiting])
        ends = np.cumsum(lengths)
        first, n, lead, gram, context = anchor_ranges(np.concatenate([t for _, _, t in self.waiting]), ends, self.shape)
        of = np.searchsorted(ends, first, "right")
        shift = np.array([at for _, at, _ in self.waiting]) - (ends - lengths)
        uids = np.array([u for u, _, _ in self.waiting], np.int64)
        self.parts.append((gram, context, uids[of], first + shift[of], n, lead))
        self.waiting, self.size = [], 0

    def batch(self, every: bool) -> pa.RecordBatch:
        """One row for each context, that of its first window; and the spans of its others, joined where they touch.

        place holds start, n, lead and whether there are others; it is negative for spans, whose length is then in context.
        every: the first is repeated, too, and so needs a mark.
        """
        self._flush()
        if not self.parts:
            self.parts = [(np.empty(0, U),) * 2 + (np.empty(0, np.int64),) * 4]
        gram, context, uid, start, n, lead = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.lexsort((start, uid, context, gram))
        gram, context, uid, start, n, lead = (x[order] for x in (gram, context, uid, start, n, lead))
        new = np.ones(len(gram), bool)
        new[1:] = (np.diff(context) != 0) | (np.diff(gram) != 0)
        heads = np.flatnonzero(new)
        several = np.diff(np.append(heads, len(gram))) > 1
        place = (start << 17) | (n << 9) | (lead << 1)
        s_uid, s_start, s_length = join_spans(uid[~new], start[~new], n[~new] - 1 + self.shape.span)
        columns = [
            np.concatenate([gram[heads].view(np.int64), mix(s_uid.view(U) ^ mix(s_start.view(U))).view(np.int64)]),
            np.concatenate([context[heads].view(np.int64), s_length]),
            np.concatenate([uid[heads], s_uid]),
            np.concatenate([place[heads] | several, -1 - s_start]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ANCHOR_FIELDS)


def join_spans(uid: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch become one. For spans that aren't nested, as those of windows in order of their start."""
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], (start + length)[order]
    new = np.ones(len(uid), bool)
    new[1:] = (np.diff(uid) != 0) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(uid)) - 1
    return uid[first], start[first], (end[last] - start[first]) if len(first) else start[first]


Tokens = Callable[[bytes], np.ndarray]


def anchor_rows(docs: DataFrame, tokens: Tokens, shape: Shape, every: bool) -> DataFrame:
    """Anchors and spans of (uid, text); each Arrow batch is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = Block(shape)
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                block.add(uid, tokens(text.as_py() or b""))
            yield block.batch(every)

    return docs.select("uid", "text").mapInArrow(run, ANCHOR_SCHEMA)


def settle(batches: Iterator[pa.RecordBatch], span: int, every: bool) -> Iterator[pa.RecordBatch]:
    """From rows sorted by gram, context, uid, place: spans (gram null), and open anchors with n and lead for length.

    Without `every`, the first of equal contexts isn't a repeat. Of a group, no more than its last context is held.
    """

    def out(uid, start, length, gram=None):
        grams = pa.nulls(len(uid), pa.int64()) if gram is None else pa.array(gram)
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(start), pa.array(length), grams], ["uid", "start", "length", "gram"])

    def spans(uid, place):
        return out(uid, place >> 17, ((place >> 9) & 255) - 1 + span)

    def opened(gram, uid, place):
        return out(uid, place >> 17, (place >> 1) & 0xFFFF, gram)

    held, shared = [np.empty(0, np.int64)] * 4, False
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ANCHOR_FIELDS]
        ready = rows[3] < 0
        if ready.any():
            yield out(rows[2][ready], -1 - rows[3][ready], rows[1][ready])
            rows = [r[~ready] for r in rows]
        gram, context, uid, place = (np.concatenate(x) for x in zip(held, rows, strict=True))
        if not len(gram):
            continue
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = np.diff(gram) != 0
        new = new_gram.copy()
        new[1:] |= np.diff(context) != 0
        yield spans(uid[~new], place[~new])
        heads = np.flatnonzero(new)
        place = place.copy()
        place[heads] |= np.diff(np.append(heads, len(gram))) > 1
        groups = np.flatnonzero(new_gram[heads])
        contexts = np.diff(np.append(groups, len(heads)))
        open_group = contexts > 1
        open_group[0] |= shared
        open_head = np.repeat(open_group, contexts)
        done = heads[:-1]
        if every:
            marked = done[(place[done] & 1) == 1]
            yield spans(uid[marked], place[marked])
        if open_head[:-1].any():
            now = done[open_head[:-1]]
            yield opened(gram[now], uid[now], place[now])
        held, shared = [x[heads[-1:]] for x in (gram, context, uid, place)], bool(open_head[-1])
    gram, _, uid, place = held
    if every and len(gram) and place[0] & 1:
        yield spans(uid, place)
    if shared:
        yield opened(gram, uid, place)


def settled(anchors: DataFrame, span: int, every: bool) -> DataFrame:
    rows = anchors.repartition("gram").sortWithinPartitions("gram", "context", "uid", "place")
    return rows.mapInArrow(lambda batches: settle(batches, span, every), "uid long, start long, length long, gram long")


CONTEXTS = "gram long, uid long, start long, content binary"


def open_contexts(docs: DataFrame, opened: DataFrame, cut: Callable[[bytes], Callable[[int, int], bytes]], span: int, then=None, schema: str = CONTEXTS) -> DataFrame:
    """(gram, uid, start, content): the tokens of the open anchors' windows. cut(text) gives a function of start and end. `then` makes what it wants of the batches, in the same worker."""
    lists = opened.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "gram")).alias("opened"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("opened")
            flat = items.flatten()
            start, length, gram = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            counts = np.diff(items.offsets.to_numpy())
            ends = start + (length >> 8) - 1 + span
            uid = np.repeat(batch.column("uid").to_numpy(), counts)
            content, at = [], 0
            for text, k in zip(batch.column("text").cast(pa.binary()), counts.tolist(), strict=True):
                take = cut(text.as_py())
                content += [take(s, e) for s, e in zip(start[at : at + k].tolist(), ends[at : at + k].tolist(), strict=True)]
                at += k
                if len(content) > 20_000 or at == len(uid):
                    lo = at - len(content)
                    yield pa.RecordBatch.from_arrays([pa.array(gram[lo:at]), pa.array(uid[lo:at]), pa.array(start[lo:at]), pa.array(content, pa.binary())], ["gram", "uid", "start", "content"])
                    content = []

    return docs.select("uid", "text").join(lists, "uid").mapInArrow(run if then is None else lambda batches: then(run(batches)), schema)


Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, list], tuple[np.ndarray, np.ndarray, np.ndarray]]


def solved(contexts: DataFrame, solver: Solver, batch_bytes: int = 2 << 20) -> DataFrame:
    """Spans that a solver finds in contexts; it gets those of whole grams, some grams at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            ids = [table.column(c).to_numpy() for c in ("gram", "uid", "start")]
            uid, start, length = solver(*ids, table.column("content").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (uid, start, length)], ["uid", "start", "length"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            at = 0
            sizes = np.cumsum(pa.compute.binary_length(batch.column("content")).to_numpy())
            cuts = np.append(np.flatnonzero(np.diff(gram)) + 1, len(gram))
            if held and held[-1].column("gram")[-1].as_py() != gram[0] and size >= batch_bytes:
                yield solve(held)
                held, size = [], 0
            while at < len(gram):
                base = sizes[at - 1] if at else 0
                full = cuts[(cuts > at) & (size + sizes[cuts - 1] - base >= batch_bytes)]
                to = int(full[0]) if len(full) else len(gram)
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1] - base)
                at = to
                if at < len(gram):
                    yield solve(held)
                    held, size = [], 0
        if held:
            yield solve(held)

    # a number of its own: the work is in Python, and partitions that look small in bytes aren't merged
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "gram").sortWithinPartitions("gram", "uid", "start").mapInArrow(run, "uid long, start long, length long")


Split = Callable[[bytes], list[tuple[bytes, ...]]]


DIGITS = "gram long, uid long, start long, digits array<binary>"


def digits_of(split: Split) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts to windows. split(content): the digits of each window of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, uid, start, content in zip(*(batch.column(c).to_pylist() for c in ("gram", "uid", "start", "content")), strict=True):
                digits = split(content)
                n = len(digits)
                columns = [pa.array(np.full(n, gram)), pa.array(np.full(n, uid)), pa.array(np.arange(start, start + n)), pa.array([list(d) for d in digits], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "uid", "start", "digits"])

    return run


def refined(windows: DataFrame, solver: Solver, shape: Shape, every: bool) -> DataFrame:
    """Spans in windows (DIGITS) of hot grams, by passes over their digits.

    A group is named by a 64-bit hash of its digits so far. Should two groups share a name, the solver still compares tokens, and the last pass groups by them.
    """

    rows = materialize(windows, "digits")
    most = max(1, shape.hot // 4)  # windows come one by one here, contexts hold many
    found = None
    for k in range(len(shape.digits) - 1):
        rows = rows.withColumn("gram", F.xxhash64("gram", F.col("digits")[k]))
        sizes = materialize(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "groups", few_files=True)
        n_few, n_many = sizes.agg(F.count_if(F.col("n") <= most), F.count_if(F.col("n") > most)).first()
        few = rows.join(small(sizes.where(F.col("n") <= most).select("gram"), n_few), "gram", "left_semi")
        spans = solved(few.select("gram", "uid", "start", F.expr("aggregate(digits, cast('' as binary), (a, d) -> concat(a, d))").alias("content")), solver)
        found = spans if found is None else found.union(spans)
        if not n_many:
            return found
        rows = materialize(rows.join(small(sizes.where(F.col("n") > most).select("gram"), n_many), "gram", "left_semi"), "digits")
    # with the last digit the windows of a group are equal throughout: large classes are told by counting
    by = materialize(rows.groupBy("digits").agg(F.min(F.struct("uid", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digits", "first"), "classes")
    hits = rows.join(small(by, by.count(), 256), "digits")
    if not every:
        hits = hits.where(F.struct("uid", "start") != F.col("first"))
    return found.union(hits.select("uid", "start", F.lit(shape.span).cast("long").alias("length")))


def repeats(docs: DataFrame, shape: Shape, tokens: Tokens, cut, split: Split, solver: Solver, every: bool) -> DataFrame:
    """(uid, spans): for each document with repeated windows, their spans; they may overlap. docs: uid (unique), text."""
    found = materialize(settled(anchor_rows(docs, tokens, shape, every), shape.span, every), "settled")
    opened = found.where("gram is not null")
    spans = found.where("gram is null").select("uid", "start", "length")
    hot = materialize(opened.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > shape.hot).select("gram"), "hot")
    n_hot = hot.count()
    if n_hot:
        hot_rows = opened.join(small(hot, n_hot), "gram", "left_semi")
        spans = spans.union(refined(open_contexts(docs, hot_rows, cut, shape.span, digits_of(split), DIGITS), solver, shape, every))
        opened = opened.join(small(hot, n_hot), "gram", "left_anti")
    spans = spans.union(solved(open_contexts(docs, opened, cut, shape.span), solver))
    return spans.groupBy("uid").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def with_uid(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, text): uid is unique and in the order of the ids, null last. It is the id itself where ids are integers, unique and not null."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    integers = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    if integers and rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return rows.withColumn("uid", F.col("doc_id").cast("long"))
    rows = identified(rows)
    words = ["_loom_h1", "_loom_h2"]
    uids = numbered(rows.select("doc_id", *words), [F.col("doc_id").asc_nulls_last(), *map(F.col, words)], "uid").drop("doc_id")
    return rows.join(uids, words).select("doc_id", "text", "uid")
