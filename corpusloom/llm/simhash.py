"""Operator 2, SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three bits are linked. Cut into two halves, one
half differs in at most one bit. So each distinct fingerprint is indexed under each half with
each one bit left out (64 signatures of 31 bits), an equality shuffle brings those that share a
signature together, and the whole distance is verified there. A group emits a spanning forest
of its links, never all pairs; groups beyond a bound are indexed again by the variants of the
other half. Connected components of the forest's edges give the classes.

Exact copies share a fingerprint, and only distinct fingerprints are indexed, so a class of
copies costs as much as one document.

Defined cases: null, empty and blank texts have fingerprint zero; very long texts are read whole, their shingles hashed in parts; a null
id joins the class of its text but never names it (a class of null ids only has a null component_id); rows that repeat are
separate rows of one class, of which keep_one() keeps one; of rows with one id keep_one() prefers the smaller content hash; empty
tables give empty results; extra columns are kept by keep_one(), whatever their names, but for names that begin with _loom_.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small

#: Most bits in which linked fingerprints differ. The two-halves argument holds for three.
DISTANCE = 3
SHINGLE = 3
SEED = 42
HALF = 32
#: Members of a group that one task compares directly; beyond it they are indexed again in the task.
GROUP = 4096
#: Members of a group that one task gathers; beyond it they go through another shuffle.
GATHER = 200_000


def fingerprint(text: bytes | None) -> int:
    """SimHash of the text's word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[SHINGLE - 1 :] or ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(values)], ["doc_id", "content", "fp"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, fp), materialised; content tells rows with one id apart."""
    rows = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))
    out = rows.mapInArrow(_fingerprints, f"doc_id {df.schema[key].dataType.simpleString()}, content long, fp long")
    return materialize(out, "fingerprints", few_files=True)


def _forest(members: np.ndarray, across: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the members (distinct) within DISTANCE. across: pairs that agree in this bit may be left out, unless -1."""
    if len(members) > GROUP:
        return _split(members)
    left, found = members, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            apart = left ^ one
            near = np.bitwise_count(apart) <= DISTANCE
            if across >= 0:
                near &= (apart >> np.uint64(across)) & np.uint64(1) == 1
            if near.any():
                new = left[near]
                found.append((np.full(len(new), one), new))
                queue.extend(new)
                left = left[~near]
    return found


def _split(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for many members, by the same argument once more: of the bits in which they vary, one half differs in at most one.

    Each level halves the varying bits; with twelve of them no more than GROUP distinct members are left.
    """
    vary = int(np.bitwise_or.reduce(members) ^ np.bitwise_and.reduce(members))
    bits = [b for b in range(64) if vary >> b & 1]
    found = []
    for half in (bits[: len(bits) // 2], bits[len(bits) // 2 :]):
        mask = sum(1 << b for b in half)
        for b in half:
            part = members & np.uint64(mask ^ (1 << b))
            order = np.argsort(part, kind="stable")
            for group in np.split(members[order], np.flatnonzero(np.diff(part[order])) + 1):
                if len(group) > 1:
                    found += _forest(group)
    return found


def _links(batches: Iterator[pa.RecordBatch], gather: int | None = GATHER) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature: kind 0, a link (a, b); kind 1, a row (signature, fingerprint) of a group of more than `gather` members, which must be shuffled again."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def solve(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
        many = ends - starts > 1
        found = []
        for s, e in zip(starts[many], ends[many], strict=True):
            group = fps[s:e]
            across = int(keys[s] >> np.int64(HALF))
            if across % HALF == 0 or across >= 2 * HALF:  # here also those that agree in the whole half are linked
                found += _forest(group)
            elif int(np.bitwise_or.reduce(group) ^ np.bitwise_and.reduce(group)) >> across & 1:
                found += _forest(group, across)
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield out(0, a, b)

    keys, fps, deferred = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        keys = np.append(keys, batch.column("key").to_numpy(zero_copy_only=False))
        fps = np.append(fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        if not len(keys):
            continue
        last = np.searchsorted(keys, keys[-1])  # where the unfinished group begins
        if deferred is not None:
            n = np.searchsorted(keys, deferred, "right")
            yield out(1, keys[:n], fps[:n])
            keys, fps, last = keys[n:], fps[n:], max(0, last - n)
            deferred = deferred if not len(keys) else None
        yield from solve(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
        if gather is not None and len(keys) > gather:
            yield out(1, keys, fps)
            deferred = keys[-1]
            keys, fps = keys[:0], fps[:0]
    yield from solve(keys, fps) if len(keys) else ()


def _grouped(rows: DataFrame, gather: int | None) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda batches: _links(batches, gather), "kind int, a long, b long")


def links(fps: DataFrame, gather: int = GATHER) -> DataFrame:
    """(a, b): fingerprints within DISTANCE, enough of them to connect all that are connected."""
    position = F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("position")
    rows = fps.select("fp", position)
    half = F.when(F.col("position") < HALF, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", HALF))
    left_out = F.expr(f"~shiftleft(1L, position % {HALF})")
    rows = rows.select((F.expr(f"shiftleft(cast(position as bigint), {HALF})") + half.bitwiseAND(left_out)).alias("key"), "fp")
    found = materialize(_grouped(rows, gather), "links", few_files=True)
    again = found.where("kind = 1")
    if again.isEmpty():
        return found.where("kind = 0").select("a", "b").distinct()
    # groups beyond GATHER: their members agree in one half but for a bit; index the other half's quarters, each with one bit left out
    other = F.when(F.shiftright("a", HALF) < HALF, F.shiftrightunsigned("b", HALF)).otherwise(F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)))
    again = again.select("a", F.col("b").alias("fp"), other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("position"))
    kept = F.expr("shiftright(other, 16 * cast(position / 16 as int)) & 65535L & ~shiftleft(1L, position % 16)")
    deeper = again.select(F.xxhash64("a", "position", kept).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61)).alias("key"), "fp")
    # each of these shares 46 bits or more, so that no more than 2 ** 18 distinct members are possible, and one task compares them
    return found.where("kind = 0").union(_grouped(deeper, None)).select("a", "b").distinct()


def classes(thin: DataFrame) -> DataFrame:
    """(fp, component_id, root) of each distinct fingerprint of (doc_id, fp)."""
    fps = materialize(thin.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(fps.select("fp")))
    fps = fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = fps.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(best, "root").select("fp", "component_id", "root")


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    thin = fingerprints(df, key, text)
    out = thin.join(classes(thin), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without near duplicates: of each class the row with the smallest id stays. Texts aren't shuffled while the keys of the rows that go fit a broadcast."""
    thin = fingerprints(df, key, text)
    of = materialize(classes(thin).select("fp", "root"), "classes", few_files=True)
    least = thin.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content")).alias("best"))
    best = least.join(of, "fp").groupBy("root").agg(F.min("best").alias("best"))
    judged = thin.join(of.join(best, "root").select("fp", "best"), "fp").select("doc_id", "content", "best")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("content") == F.col("best.content"))
    named = [F.col("doc_id").alias("_loom_id"), F.col("content").alias("_loom_content")]
    gone = materialize(judged.where(~first).select(*named).distinct(), "gone", few_files=True)
    # rows that stay, but are there several times
    again = materialize(judged.where(first).groupBy("doc_id", "content").agg(F.count("*").alias("n")).where("n > 1").select(*named), "again", few_files=True)
    same = F.col(key).eqNullSafe(F.col("_loom_id")) & (F.xxhash64(F.col(text)) == F.col("_loom_content"))
    n_gone, n_again = gone.count(), again.count()
    left = df.join(small(gone, n_gone), same, "left_anti")
    if not n_again:
        return left
    once = left.join(small(again, n_again), same, "left_anti")
    copies = df.join(small(again, n_again), same, "left_semi").withColumn("_loom_content", F.xxhash64(F.col(text)))
    return once.unionByName(copies.dropDuplicates([key, "_loom_content"]).drop("_loom_content"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
