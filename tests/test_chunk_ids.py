"""Passages of documents with very many sections keep ids of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans import pipelines


def test_ids_follow_document_section_and_part(spark):
    rows = spark.createDataFrame([(1, 0, 0), (0, 70000, 0), (0, 4464, 0), (0, 4464, 70000), (0, 4465, 4464), (2, 0, 0)], "doc_id long, section_idx int, part_idx int")
    got = pipelines.with_chunk_ids(rows.withColumn("text", F.lit("x"))).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(6))
    assert [tuple(r)[:3] for r in got] == [(0, 4464, 0), (0, 4464, 70000), (0, 4465, 4464), (0, 70000, 0), (1, 0, 0), (2, 0, 0)]
    assert pipelines.with_chunk_ids(rows.where("false")).collect() == []
