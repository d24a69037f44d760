"""Every query with SQL must give DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from quarrylake.plans import queries as q


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", q.QUERIES)
def test_same_rows(spark, sf_dir, duck, name):
    df = q.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = duck.sql(q.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got


def test_entry_without_the_optional_subpackage(spark, sf_dir):
    import __spark_entry__ as entry

    assert {*q.QUERIES} <= {*entry.queries()}
    assert entry.entry(spark).count() > 0
