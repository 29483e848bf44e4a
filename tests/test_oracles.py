"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillstack import catalog

SF = "/root/testdata/sf0.001"
SLOW: set[str] = set()
NAMES = sorted(set(catalog.ORACLES) - SLOW)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    relation = duck.execute(catalog.ORACLES[name])
    found = [c[0] for c in relation.description]
    assert sorted(found) == columns
    key = lambda row: tuple((v is None, str(v)) for v in row)
    ours = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key)
    theirs = sorted((tuple(r[found.index(c)] for c in columns) for r in relation.fetchall()), key=key)
    assert len(ours) == len(theirs)
    assert all(all(map(same, a, b)) for a, b in zip(ours, theirs, strict=True))
