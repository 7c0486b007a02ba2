"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

ORACLE, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return "nan" if v != v else round(float(v), 5) + 0.0
    if isinstance(v, np.generic):
        return v.item()
    return v


def rows(records, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    expected = rows((dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()), columns)
    got = rows((r.asDict() for r in df.collect()), columns)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or x == pytest.approx(y, abs=2e-5), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
