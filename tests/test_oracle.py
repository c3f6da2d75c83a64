"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import pytest

from strataforge.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9) or (a != a and b != b)
    return a == b or (a is None and b != b) or (b is None and a != a)


def compare(spark, f, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = f(spark, DIR)
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (sorted(x[columns].astype(object).where(x[columns].notna(), None).values.tolist(), key=repr) for x in (got, want))
    assert len(a) == len(b)
    assert all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"table_stats", "block_crc32c"} <= set(entry.oracle_sql())
