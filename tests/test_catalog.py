"""Every registered query with SQL, run beside it in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from folioflow.plans import catalog

D = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        at = f"{D}/{f}/*.parquet" if os.path.isdir(f"{D}/{f}") else f"{D}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return f"{float(v):.6g}" if hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = duck.execute(SQL[name])
    names = [x[0] for x in want.description]
    assert cols == sorted(names)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_made_file_is_one_partition(spark):
    from folioflow.plans import catalog_files

    assert catalog_files._made(spark).rdd.getNumPartitions() == 1
