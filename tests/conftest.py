from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # workers import the package, too

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import build_session

    session = build_session("tests", 4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value as both engines give it: numbers rounded, nulls alike, arrays as tuples."""
    import pandas as pd

    if isinstance(value, (list, tuple)) or getattr(value, "shape", ()):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NA or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return value if isinstance(value, bool) or not isinstance(value, (int, float)) else round(float(value), 9)


def rows_of(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same(spark):
    """same(query, sql, folder): fails unless the Spark query and DuckDB's SQL give the same rows."""
    import duckdb

    def check(query, sql, folder=SMALL, tables=TABLES):
        con = duckdb.connect()
        for t in tables:
            p = f"{folder}/{t}.parquet"
            if os.path.exists(p):
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
        got, want = query(spark, folder).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
