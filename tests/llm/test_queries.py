"""The queries as they are registered, on the small shared tables."""

from __future__ import annotations

import pytest
from ..conftest import SMALL

from corpusloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_all_twelve_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 13))
    assert SMALL
