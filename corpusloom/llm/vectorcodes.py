"""Operator 12, vector code compression: product codes whose nearest codebook entries are found within a ring of norms.

Vectors become integers, are cut into PARTS parts, and each part is stood for by the number of the nearest entry of its place's codebook. The
distance of two vectors is at least the difference of their norms. So entries are sorted by norm; the entry of nearest norm gives a first
distance, a binary search the ring of entries whose norms are within that distance, and only the ring is evaluated, exactly, inclusively at
its edges, on all parts of a batch at once. Norms are floats, so the ring is taken a little wider: that evaluates more, and never leaves out
an entry. It is searched anew whenever a nearer entry has been met. Distances are integers, so results do not depend on how rows are cut into partitions.

A round is one pass over the vectors in Arrow batches: each task keeps one sum for each place, entry and component, and Spark adds up the
sums. The driver sees codebooks only: entries times components, whatever the number of rows. No row is shuffled but in thin form, for the
sums by label: these are one row a label, broadcast within the bound of `small`, else joined with the rows of each label dealt out by
SALT. Executors' loss costs the tasks that ran there; what a round needs is in its plan.

Defined cases: null vectors and those with null or non-finite components go; those of another length than the one with the smallest id stay
without code and error, and count for nothing. Null ids come last; of equal ids, the smaller vector is first. With fewer than ENTRIES
vectors codebooks have fewer entries; a table without vectors gives no rows. A length that PARTS doesn't divide is cut as evenly as it can be, empty
parts have code 0 and error 0. Ties go to the lower index, repeated rows get equal codes. Components too large for 64-bit sums of squares are computed with integers of any size, without a ring; errors and
their sums beyond a long are its largest value. Null labels are one label. Extra columns do no harm, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of an equal label are dealt to so many tasks where sums by label are too many to broadcast.
SALT = 16
#: Bits of a limb: sums travel in limbs, so that Spark can add up any number of any size as longs.
LIMB = 30
LONGEST = (1 << 63) - 1


def cuts(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [i * length // parts for i in range(parts + 1)]


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): longs where sums of squares of differences stay below 2 ** 62, else Python's integers."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= narrow(vectors.shape[1]):
        factor = np.frompyfunc(lambda x: math.floor(x) * scale + math.floor((x - math.floor(x)) * scale), 1, 1)
        return factor(vectors.astype(np.float64).astype(object))
    return scaled.astype(np.int64)


def narrow(length: int) -> float:
    """Components below this can be computed with longs: (2 m) ** 2 * length < 2 ** 62."""
    return 2.0 ** ((60 - max(length, 1).bit_length()) // 2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the entry of the book that is nearest to each row of x, ties to the lower index; and how many distances were computed."""
    if x.dtype == object or book.dtype == object:
        far = np.array([((x.astype(object) - e) ** 2).sum(axis=1) for e in book.astype(object)], object).reshape(len(book), len(x))
        best = far.argmin(axis=0) if len(x) else np.zeros(0, np.int64)
        return best, far[best, np.arange(len(x))], far.size
    norms = np.sqrt((book * book).sum(axis=1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    sorted_norms = norms[order]
    own = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    # the entry of nearest norm gives the first distance
    right = np.searchsorted(sorted_norms, own).clip(1, max(len(book) - 1, 1))
    at = np.where(own - sorted_norms[right - 1] <= sorted_norms[np.minimum(right, len(book) - 1)] - own, right - 1, np.minimum(right, len(book) - 1))
    best, least = order[at], ((x - book[order[at]]) ** 2).sum(axis=1)
    low, high = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)

    def ring(rows) -> None:
        """The entries that the distance of these rows allows so far, a little wider than rounding can be wrong by."""
        reach = np.sqrt(least[rows].astype(np.float64))
        slack = (own[rows] + reach + sorted_norms[-1] + 1) * 1e-12
        low[rows] = np.searchsorted(sorted_norms, own[rows] - reach - slack, "left")
        high[rows] = np.searchsorted(sorted_norms, own[rows] + reach + slack, "right")

    ring(np.arange(len(x)))
    computed = len(x)
    for step in range(1, len(book)):  # outwards from the nearest norm; the ring narrows as distances do
        for place in (at - step, at + step):
            rows = np.flatnonzero((low <= place) & (place < high))
            entry = order[place[rows]]
            computed += len(rows)
            far = ((x[rows] - book[entry]) ** 2).sum(axis=1)
            nearer = (far < least[rows]) | ((far == least[rows]) & (entry < best[rows]))
            rows = rows[nearer]
            best[rows], least[rows] = entry[nearer], far[nearer]
            ring(rows)
    return best, least, computed


def kept(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[int | None, list[np.ndarray]]:
    """The length of vectors, and the codebooks to start from: the parts of the vectors with the smallest ids. `vectors` has _id and _v."""
    by_id = (F.col("_id").asc_nulls_last(), "_v")
    first = vectors.select("_id", "_v").orderBy(*by_id).first()
    if first is None:
        return None, []
    length = len(first["_v"])
    few = vectors.where(F.size("_v") == length).select("_id", "_v").orderBy(*by_id).limit(entries).collect()
    whole = integers(np.array([r["_v"] for r in few], np.float64).reshape(len(few), length))
    at = cuts(length, parts)
    return length, [whole[:, a:b] for a, b in zip(at, at[1:])]


def limbs(value: int) -> list[int]:
    """The value in limbs of LIMB bits, the last one signed."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def refined(vectors: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Codebooks after one round: every entry becomes the floor of the mean of the parts that are nearest to it; unused ones stay."""
    at = cuts(length, len(books))
    sizes = [len(b) for b in books]

    def sums(batches):
        total = [np.zeros((n, b - a + 1), object) for n, a, b in zip(sizes, at, at[1:])]
        for batch in batches:
            whole = integers(_matrix(batch.column(0), length))
            for part, book in enumerate(books):
                x = whole[:, at[part] : at[part + 1]]
                code = nearest(x, book)[0]
                for entry in np.unique(code):
                    rows = x[code == entry]
                    total[part][entry] += np.append(rows.sum(axis=0).astype(object), len(rows))
        rows = [(p, e, i, n, limb) for p, t in enumerate(total) for e in range(len(t)) if t[e][-1] for i, value in enumerate(t[e]) for n, limb in enumerate(limbs(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k < 4 else pa.int64()) for k in range(5)], names=["part", "entry", "place", "limb", "value"])

    got = vectors.select("_v").mapInArrow(sums, "part int, entry int, place int, limb int, value long").groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
    total: dict = {}
    for r in got:
        total[r.part, r.entry, r.place] = total.get((r.part, r.entry, r.place), 0) + (r.value << (LIMB * r.limb))
    out = []
    for part, book in enumerate(books):
        width = at[part + 1] - at[part]
        rows = [[total[part, e, i] // total[part, e, width] for i in range(width)] if (part, e, width) in total else [int(c) for c in book[e]] for e in range(sizes[part])]
        wide = any(abs(c) >= narrow(length) for row in rows for c in row)
        out.append(np.array(rows, object if wide else np.int64).reshape(sizes[part], width))
    return out


def coded(vectors: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """vectors (of _id, _label, _v) with _code and _error in place of _v."""
    at = cuts(length, len(books))
    schema = f"_id {vectors.schema['_id'].dataType.simpleString()}, _label {vectors.schema['_label'].dataType.simpleString()}, _code string, _error long"

    def codes(batches):
        for batch in batches:
            whole = integers(_matrix(batch.column(2), length))
            found = [nearest(whole[:, a:b], book)[:2] for a, b, book in zip(at, at[1:], books)]
            digits = np.array([code for code, _ in found], np.uint8).T
            error = sum(far.astype(object) for _, far in found)
            text = pa.array([row.tobytes().hex() for row in np.ascontiguousarray(digits)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array([min(int(e), LONGEST) for e in error], pa.int64())], names=["_id", "_label", "_code", "_error"])

    return vectors.select("_id", "_label", "_v").mapInArrow(codes, schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, code, error) of the rows that are kept, written once; and the codebooks."""
    rows = kept(df, vector).select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v"))
    length, books = first_books(rows)
    columns = [F.col("_id").alias(key), F.col("_label").alias(label), F.col("_code").alias("code"), F.col("_error").alias("error")]
    if length is None:
        return rows.select("_id", "_label", F.lit(None).cast("string").alias("_code"), F.lit(None).cast("long").alias("_error")).select(*columns), books
    fit = rows.where(F.size("_v") == length)
    for _ in range(rounds):
        books = refined(fit, books, length)
    others = rows.where(F.size("_v") != length).select("_id", "_label", F.lit(None).cast("string").alias("_code"), F.lit(None).cast("long").alias("_error"))
    return materialize(coded(fit, books, length).unionByName(others), "codes").select(*columns), books


def label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error, the sum of the errors of all rows with an equal label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col(label).alias("_label")).agg(total.alias("label_error"))
    n = sums.count()
    salt = F.pmod(F.xxhash64("code", "error", codes.columns[0]), F.lit(SALT))
    if small(sums, n) is sums:
        dealt = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        joined = codes.withColumn("_own", salt).join(dealt, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt")))
    else:
        joined = codes.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(*codes.columns, "label_error")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The contract as DuckDB SQL, a common table for each round."""
    far = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, k AS part, e[k * len(e) // {PARTS} + 1 : (k + 1) * len(e) // {PARTS}] AS x FROM v, range({PARTS}) AS r(k))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, n.entry AS entry, n.d AS d FROM (SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min({{'d': {far}, 'entry': b.entry}}) AS n FROM p JOIN b{r} b ON b.part = p.part GROUP BY ALL))")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT part, entry, place, sum(y) AS total, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{r}) GROUP BY ALL)")
            steps.append(f"m{r} AS (SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM s{r} GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)")
    steps.append(f"e AS (SELECT vec_id, label, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h"


OP12_SQL = _sql()
