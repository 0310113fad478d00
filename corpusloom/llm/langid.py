"""Operator 7, language identification: family first, then one-versus-one linear SVMs within it.

Texts become vectors of hashed byte trigrams of the lower-cased text, square roots of their counts, scaled to
length one. A linear support vector machine for each pair of families votes for the family; one for each pair of the
family's languages votes for the language. Both are trained on the driver by dual coordinate
descent on a sample of at most SAMPLE_ROWS labelled rows, chosen by a hash of id and text, rows that repeat once; FEWEST_ROWS of
each language are learned from even if there are so many languages that it takes more. Every label that has a row with a letter is learned. A vector takes WIDTH floats (32 KiB), and so
does the classifier of each pair of one family's languages. Prediction is one pass over the whole texts.

Defined cases: null and empty texts and texts without a letter are `und` with score 0, and so is everything if nothing was
learned; null ids are neither learned from nor held out; very long texts are read whole; of languages with equal votes and margins the
first by code point is predicted; empty tables give empty results; repeated rows are predicted alike; extra columns do no harm, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that are learned from at most, over all languages, and of one language; and the bound for one language that isn't gone below.
SAMPLE_ROWS = 4000
LANGUAGE_ROWS = 300
FEWEST_ROWS = 5
#: Length of the hashed trigram vectors.
WIDTH = 1 << 13
UND = "und"
#: Language codes by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro", "rm"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "indo-iranian": ["bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ur"],
}

_letter = regex.compile(r"\p{L}").search


def family(code: str) -> str:
    return next((name for name, codes in FAMILIES.items() if code.lower().split("-")[0] in codes), "other")


def vector(text: str) -> np.ndarray:
    """Hashed trigram counts, square-rooted, of length one."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(WIDTH)
    for at in range(0, len(raw) - 2, 1 << 20):  # very long texts by parts
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        grams = (b[:-2] << 16) + (b[1:-1] << 8) + b[2:]
        counts += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=WIDTH)
    x = np.sqrt(counts)
    return (x / max(np.sqrt(counts.sum()), 1e-9)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss (bias last), by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, diagonal = np.zeros(x.shape[1]), np.zeros(len(x)), 0.5 / c
    norms = (x.astype(np.float64) ** 2).sum(axis=1) + diagonal
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + diagonal * alpha[i]
            new = max(0.0, alpha[i] - slope / norms[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """The two levels of classifiers. weights has a column for each pair in pairs."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        kinds = {lang: family(lang) for lang in self.languages}
        self.families = sorted(set(kinds.values()))
        self.members = {f: [lang for lang in self.languages if kinds[lang] == f] for f in self.families}
        self.pairs = [*combinations(self.families, 2)] + [p for f in self.families for p in combinations(self.members[f], 2)]
        got, kind = np.array(labels), np.array([kinds[lang] for lang in labels])
        columns = []
        for n, (a, b) in enumerate(self.pairs):
            of = kind if n < len(self.families) * (len(self.families) - 1) // 2 else got
            rows = (of == a) | (of == b)
            columns.append(train_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0)))
        self.weights = np.array(columns, np.float32).T if columns else np.zeros((WIDTH + 1, 0), np.float32)
        self.at = {p: i for i, p in enumerate(self.pairs)}

    def _best(self, among: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The one with most votes, then the largest sum of margins; and how sure, from its narrowest victory."""
        if len(among) == 1:
            return among[0], 1.0
        against = {a: [margins[self.at[a, b]] if (a, b) in self.at else -margins[self.at[b, a]] for b in among if b != a] for a in among}
        best = max(among, key=lambda a: (sum(m > 0 for m in against[a]), sum(against[a])))
        return best, float(1 / (1 + np.exp(-4 * min(against[best]))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _letter(text):
            return UND, 0.0
        margins = vector(text) @ self.weights[:-1] + self.weights[-1]
        kind, sure = self._best(self.families, margins)
        lang, surer = self._best(self.members[kind], margins)
        return lang, sure * surer


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows with a label that aren't held out."""
    rows = df.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(f"k is not null and lang is not null and lang <> '{UND}' and text rlike '\\\\p{{L}}'").where(~held_out("k"))
    rows = rows.withColumn("draw", F.xxhash64("k", "text"))
    # one row a label: how many different rows it has, about, and the one that is learned from in any case
    found = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least")).collect()
    if not found:
        return Model(np.zeros((0, WIDTH), np.float32), [])
    most = min(LANGUAGE_ROWS, max(FEWEST_ROWS, SAMPLE_ROWS // len(found)))
    by_lang = lambda value: F.create_map(*[F.lit(v) for r in sorted(found) for v in (r["lang"], value(r))])[F.col("lang")]
    below = F.pmod("draw", F.lit(1_000_003)) < by_lang(lambda r: 1_000_003 * min(1.0, (2.0 * most + 20) / r["n"]))
    few = rows.where(below | (F.col("draw") == by_lang(lambda r: r["least"])))
    few = few.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(f"rank <= {most}")

    def vectors(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf.lang, "x": [vector(t).tobytes() for t in pdf.text]})

    got = few.select("lang", "text").mapInPandas(vectors, "lang string, x binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, WIDTH)
    return Model(x, [r.lang for r in got])


def predict(df: DataFrame, model: Model, text: str = "text", columns: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df without the text column's copy: its columns and the two predictions, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    got = df.withColumn("_loom_guess", guess(F.col(text)))
    return got.withColumns({columns[0]: F.col("_loom_guess.lang"), columns[1]: F.col("_loom_guess.score")}).drop("_loom_guess")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
