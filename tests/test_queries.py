"""Each query with SQL gives the same rows in Spark and in DuckDB."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(entry.catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = rows_of(df.collect(), df.columns, names)
    if name not in entry.catalogue.ORACLES:
        assert got
        return
    want = duck.execute(entry.catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    assert got == rows_of(want.fetchall(), columns, names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
