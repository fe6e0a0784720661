"""Every registered query of the peak engine against its DuckDB SQL, on the smallest tables."""

import glob
import os

import pytest

from spectrail.plans import catalog

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees(spark, duck, name):
    df = catalog.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(duck.execute(f"SELECT {names} FROM ({catalog.ORACLE_SQL[name]})").fetchall(), key=key)
    assert got == want


def test_flagship_and_order(spark):
    rows = catalog.flagship(spark, TABLES).collect()
    assert rows and [(r.spectrum_id_, r.peak_) for r in rows] == sorted((r.spectrum_id_, r.peak_) for r in rows)


def test_entry():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
