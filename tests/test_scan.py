"""Prefix combinations against a plain fold."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from deltaspark.collection import Collection
from deltaspark.operators.scan import prefix


def fold(items):
    """The concatenation before each (position, value)."""
    out, acc = {}, None
    for p, v in sorted(items):
        out[p] = acc
        acc = acc if v is None else v if acc is None else acc + v
    return out


def test_a_function_that_does_not_commute(spark):
    rng = random.Random(5)
    table = []
    for key in ("a", "b", None):
        for p in rng.sample(range(-300, 900), 60):
            table.append((key, p, rng.choice(["x", "y", "zz", "", None]), p * 2))
    df = spark.createDataFrame(table, "k string, p long, v string, other long")
    got = prefix(df, "p", "v", F.concat, ["k"], block=4)
    assert got.columns == ["k", "p", "v", "other", "before"]
    want = {(k, p): b for k in ("a", "b", None) for p, b in fold([(p, v) for x, p, v, _ in table if x == k]).items()}
    rows = got.collect()
    assert len(rows) == len(table) and {(r.k, r.p): r.before for r in rows} == want and all(r.other == r.p * 2 for r in rows)


def test_other_locations(spark):
    values = [(1, "a"), (4, "b"), (9, "c"), (70, "d")]
    at = [(0,), (1,), (2,), (10,), (71,), (500,)]
    got = prefix(spark.createDataFrame(values, "p long, v string"), "p", "v", F.concat, at=spark.createDataFrame(at, "p long"), block=4)
    assert {r.p: r.before for r in got.collect()} == {0: None, 1: None, 2: "a", 10: "abc", 71: "abcd", 500: "abcd"}


def test_empty_single_and_repeated_positions(spark):
    schema = "p long, v long"
    assert prefix(spark.createDataFrame([], schema), "p", "v", lambda a, b: a + b).collect() == []
    assert [tuple(r) for r in prefix(spark.createDataFrame([(7, 3)], schema), "p", "v", lambda a, b: a + b).collect()] == [(7, 3, None)]
    repeated = prefix(spark.createDataFrame([(1, 5), (1, 2), (2, 9)], schema), "p", "v", lambda a, b: a + b)
    assert sorted(tuple(r) for r in repeated.fillna(0).collect()) == [(1, 2, 0), (1, 5, 2), (2, 9, 7)]


def test_keyless_sums_are_in_blocks(spark):
    c = Collection.of(spark.range(2000).select(F.col("id").alias("p"), (F.col("id") % 7).alias("v"))).prefix_sum("p", "v")
    assert "SinglePartition" not in c.df._jdf.queryExecution().toString()
    total, want = 0, {}
    for p in range(2000):
        want[p] = total
        total += p % 7
    assert {r.p: r["sum"] for r in c.df.collect()} == want
