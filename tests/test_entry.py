"""The registered queries run, and those with SQL give the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from angulon.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(text, r)) for r in frame[names].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(db.execute(registry.ORACLE_SQL[name]).df())


def test_entry_points():
    assert "redundancy_centroid" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
