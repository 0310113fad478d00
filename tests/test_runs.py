"""Queries of whole runs over files agree with DuckDB."""

from __future__ import annotations

import pytest

from corpusloom.plans import runs


@pytest.mark.parametrize("name", sorted(runs.QUERIES))
def test_matches_sql(name, same):
    same(runs.QUERIES[name], runs.SQL[name])
