"""Every registered query with an equivalent gives the same rows as DuckDB does, at the smallest scale."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 9) if isinstance(value, float) else int(value) if isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: Counter(tuple(map(plain, r)) for r in found)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith(("op", "pipeline"))))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
