"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from heliograph.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert got
    if name in registry.ORACLES:
        r = db.sql(registry.ORACLES[name])
        names = r.columns
        assert sorted(names) == cols
        assert got == Counter(tuple(dict(zip(names, x, strict=True))[c] for c in cols) for x in r.fetchall())
