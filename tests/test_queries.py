"""Every query with SQL gives DuckDB's rows for it, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from deltaspark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in catalogue.QUERIES.items() if sql))
def test_query(spark, db, name):
    run, sql = catalogue.QUERIES[name]
    got = run(spark, FOLDER)
    names = sorted(got.columns)
    want = db.execute(sql)
    at = [d[0] for d in want.description]
    assert sorted(at) == names
    order = [at.index(n) for n in names]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == expected


def test_entry_points():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
