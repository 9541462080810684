"""Every registered plan against its SQL on the smallest tables, where these are there."""

import math
import os

import pytest

import weftlake.plans.auditing
import weftlake.plans.files
import weftlake.plans.made
import weftlake.plans.pipelines
import weftlake.plans.relational
import weftlake.plans.streams
import weftlake.plans.texts
import weftlake.plans.vectors
from weftlake.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(v)
        return None if v is None else str(v)

    return sorted(tuple(one(r[i]) or "" for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, duck, name):
    out = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in out.collect()]
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(out.columns)
        assert rows(out.columns, got) == rows(columns, want.fetchall())
    else:
        assert got
