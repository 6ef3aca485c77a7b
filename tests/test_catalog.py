"""Each registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from curatrix.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(v) else float(f"{float(v):.6g}")
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    got = frame.collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, got) == rows(want.columns, want.fetchall())
