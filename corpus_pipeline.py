"""The training-data pipeline: stages over the documents table, each calling one operator.

Every stage works on all rows of its predecessor's result, which is written to the shared folder in between. For all stages: null and
empty texts are those that the first one takes out; very long texts are read whole; rows that repeat are rows of their own, of which
near-duplicate removal leaves one; where rows tie, ids decide, then content; null ids come last; empty tables give empty results; extra
columns are kept, whatever their names, but for names that begin with _loom_.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, langid, mixing, sharding, simhash
from corpusloom.llm.common import materialize


def language(spark, docs, sf_dir):
    """Documents for which a language is found; null texts and those without any letter go."""
    found = langid.predict(docs, langid.fit(docs), columns=("_loom_lang", "_loom_score"))
    return found.where(F.col("_loom_lang") != langid.UND).select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near duplicates: the one with the smallest id; of rows with that id the one with the smaller content hash, once."""
    return simhash.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item. Equal rows are judged alike."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """Each document as often as the mix to target weights takes it, so up to three times; which ones is by a hash of id and text, and of a written place for rows that repeat."""
    rows = mixing.mix(docs).where("_loom_copies > 0")
    return rows.withColumn("_loom_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_loom_copies"))).select(*docs.columns)


def shards(spark, docs, sf_dir):
    """Every document with its shard; copies of one document may be in different shards."""
    return sharding.shard(docs).drop("_loom_bytes")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]

#: Language identification and SimHash can't be expressed in DuckDB's SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
