"""Every registered query against its SQL on the smallest tables, both read whole."""

import math
import os

import duckdb
import pytest

from corpusq.plans import advanced, catalog, more  # the others add their queries to those of catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted({**more.QUERIES, **advanced.QUERIES}))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = oracle.sql(catalog.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
