"""Every core query at the smallest scale against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from lumenfold.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name not in ORACLE_SQL:
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda f: sorted(map(tuple, f[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
