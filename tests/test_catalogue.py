"""Every query of the catalogue runs; those with SQL agree with DuckDB."""

from __future__ import annotations

import pytest
from .conftest import SMALL

from corpusloom.plans import catalogue, runs
from jobs import queries as job_queries


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
    assert set(runs.QUERIES) == set(runs.SQL)


def test_entry_point(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_plans_push_down(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    chunks = plan(catalogue.sliding_chunks(spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in chunks
    assert "Exchange hash" not in chunks and "Exchange range" not in chunks
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in plan(catalogue.clean_answers(spark, SMALL))


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without subpackage llm and the pipeline imports, and lists the other queries."""
    import shutil
    import subprocess
    import sys

    from .conftest import ROOT

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, check=True)
    assert said.stdout.split("\n")[0] == f"{len(catalogue.QUERIES | runs.QUERIES | job_queries.QUERIES)} {len(catalogue.SQL | runs.SQL | job_queries.SQL)} []"
