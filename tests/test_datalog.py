from __future__ import annotations

import random

import pytest

from deltaspark.plans import datalog


def got(df):
    return sorted(map(tuple, df.collect()))


def test_closure_and_negation(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(12)})
    table = spark.createDataFrame(edges, "a long, b long")
    out = datalog.run(["path(x, y) :- e(x, y)", "path(x, z) :- path(x, y), e(y, z)", "node(x) :- e(x, _)", "node(y) :- e(_, y)", "lost(x) :- node(x), !path(0, x)", "loop(x) :- path(x, x)"], {"e": table})
    paths = set(edges)
    while True:
        more = {(a, d) for a, b in paths for c, d in edges if b == c} - paths
        if not more:
            break
        paths |= more
    assert got(out["path"]) == sorted(paths)
    nodes = {x for e in edges for x in e}
    assert got(out["lost"]) == sorted((n,) for n in nodes if (0, n) not in paths)
    assert got(out["loop"]) == sorted((a,) for a, b in paths if a == b)


def test_points_to_with_mutual_recursion(spark):
    """Values flow along assignments, and through memory that two names may share."""
    assign = [(1, 2), (2, 3), (5, 6)]
    dereference = [(2, 10), (3, 11), (6, 12), (10, 13)]
    rules = [
        "flow(x, y) :- a(x, y)", "flow(x, z) :- flow(x, y), flow(y, z)", "flow(x, w) :- a(x, z), alias(z, w)",
        "alias(x, y) :- d(p, x), values(p, q), d(q, y)", "values(x, y) :- flow(z, x), flow(z, y)",
    ]
    out = datalog.run(rules, {"a": spark.createDataFrame(assign, "x long, y long"), "d": spark.createDataFrame(dereference, "p long, x long")})
    flow, alias, values = set(assign), set(), set()
    while True:
        before = len(flow) + len(alias) + len(values)
        flow |= {(x, w) for x, z in assign for y, w in alias if y == z} | {(x, z) for x, y in flow for u, z in flow if y == u}
        values |= {(x, y) for z, x in flow for u, y in flow if z == u}
        alias |= {(x, y) for p, x in dereference for q, y in dereference if (p, q) in values}
        if before == len(flow) + len(alias) + len(values):
            break
    assert (got(out["flow"]), got(out["alias"]), got(out["values"])) == (sorted(flow), sorted(alias), sorted(values))


def test_negation_without_shared_variables(spark):
    n, flag = spark.createDataFrame([(1,), (2,)], "a long"), spark.createDataFrame([(1,)], "a long")
    rules = ["any(x) :- n(x), !flag(_)", "one(x) :- n(x), !flag(1)", "two(x) :- n(x), !flag(2)", "none(x) :- n(x), !no(_)", "both(x) :- n(x), !flag(2), !flag(x)"]
    out = datalog.run(rules, {"n": n, "flag": flag, "no": flag.where("a > 1")})
    assert {k: got(out[k]) for k in ("any", "one", "two", "none", "both")} == {"any": [], "one": [], "two": [(1,), (2,)], "none": [(1,), (2,)], "both": [(2,)]}


def test_errors(spark):
    e = {"e": spark.createDataFrame([(1, 2)], "a long, b long")}
    for rules in (["p(x) :- e(y, z)"], ["p(x)"], ["p(x) :- e(x, _), !q(x)", "q(x) :- e(x, _), !p(x)"], ["p(x, z) :- e(x, _), e(z, _)"]):
        with pytest.raises(ValueError):
            datalog.run(rules, e)
