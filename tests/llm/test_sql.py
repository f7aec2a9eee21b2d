"""The subpackage's queries against their SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from deltaspark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    expected = sorted((tuple(r[at.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == expected
