"""Queries over the session log against their SQL, on more sessions than the small tables have."""

import duckdb
import pytest

from corpusq.plans import catalog, more  # noqa: F401


@pytest.mark.parametrize("name", ["migrated_sessions", "session_writes"])
def test_many_sessions(spark, tmp_path, name):
    rows = [(i, t, "user", None if i % 50 == 0 else f"text {i} {t}") for i in range(700) for t in range(1 + i % 3)] + [(None, 1, "user", "of no session")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = catalog.QUERIES[name](spark, str(tmp_path))
        got, columns = df.collect(), df.columns
    finally:
        spark.conf.set(key, before)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
