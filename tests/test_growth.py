"""Work that must not outgrow the input: rows that operators of a plan make, and rounds of loops."""

from __future__ import annotations

import random
import re

import pytest

from deltaspark import storage
from deltaspark.operators import graphs, wcoj


def most_rows(spark, action):
    """The most rows that one operator of any plan run by action put out."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    old = store.executionsCount()
    action()
    bus.waitUntilEmpty()
    made, all_runs = 0, store.executionsList()
    for i in range(old, all_runs.size()):
        number = all_runs.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                if metrics.apply(k).name() == "number of output rows":
                    value = values.get(metrics.apply(k).accumulatorId())
                    made = max(made, int(value.get().replace(",", "")) if value.isDefined() else 0)
    return made


@pytest.fixture
def cuts(monkeypatch):
    """Tables that the graph loops write."""
    made, write = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: made.append(write(df)) or made[-1])
    return made


def test_bidijkstra_looks_up_the_smaller_frontier(spark):
    star = spark.range(300).selectExpr("0L AS src", "id + 1 AS dst")
    goals = star.select("src", "dst")
    found = []
    assert most_rows(spark, lambda: found.extend(graphs.bidijkstra(star, goals).collect())) <= 1200
    assert sorted(map(tuple, found)) == [(0, i + 1, 1) for i in range(300)]


def test_colouring_takes_blocks_not_paths(spark, cuts):
    path = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    assert sorted(map(tuple, graphs.sequence(path, graphs.least_free).collect())) == [(i, i % 2) for i in range(61)]
    assert len(cuts) <= 3


def test_sequence_over_several_blocks(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(150)}
    near = {a: {b for x in pairs for b in x if a in x and b != a} for x in pairs for a in x}
    logic = lambda node, others: node + 2 * sum(others.values()) % 1000 + len(others)
    known = {}
    for n in sorted(n for n in near if near[n]):
        known[n] = logic(n, {x: known[x] for x in near[n] if x < n})
    found = graphs.sequence(spark.createDataFrame(sorted(pairs), "src long, dst long"), logic, 20).collect()
    assert sorted(map(tuple, found)) == sorted(known.items())


def test_stable_matching_works_on_what_is_left(spark, cuts):
    n = 12  # everybody wants the same: the old loop wrote all pairs but one in each of its rounds
    wishes = spark.range(n * n).selectExpr(f"id div {n} AS left", f"id % {n} AS lpref", f"100 + id % {n} AS right", f"id div {n} AS rpref")
    assert sorted(map(tuple, graphs.stable_matching(wishes).collect())) == [(i, 100 + i) for i in range(n)]
    assert sum(t.count() for t in cuts) <= n * n * (n + 1) // 2


def test_stable_matching_is_best_for_all_lefts(spark):
    rng = random.Random(8)
    wishes = {a: rng.sample(range(12), 6) for a in range(14)}
    ranks = {b: rng.sample(range(14), 14) for b in range(12)}
    free, tried, holds = list(wishes), dict.fromkeys(wishes, 0), {}
    while free:
        a = free.pop()
        if tried[a] == len(wishes[a]):
            continue
        b, tried[a] = wishes[a][tried[a]], tried[a] + 1
        old = holds.get(b)
        if old is None or ranks[b].index(a) < ranks[b].index(old):
            holds[b], a = a, old
        if a is not None:
            free.append(a)
    rows = [(a, p, b, ranks[b].index(a)) for a, to in wishes.items() for p, b in enumerate(to)]
    found = graphs.stable_matching(spark.createDataFrame(rows, "left long, lpref long, right long, rpref long")).collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for b, a in holds.items())


def test_hops_exchanges_lists(spark):
    edges = spark.range(1200).selectExpr("id % 60 AS src", "(id * 7 + id div 60) % 60 AS dst").distinct()
    pairs = {tuple(r) for r in edges.collect()}
    two = {(a, d) for a, b in pairs for c, d in pairs if b == c}
    expected = sorted({(a, d) for a, b in two for c, d in pairs if b == c})
    roots = edges.selectExpr("src AS node").distinct()
    for most in (graphs.MOST_LISTED, 5):
        found = graphs.hops(edges, roots, 3, most)
        assert sorted(map(tuple, found.collect())) == expected
    # the old form made a row for each edge after each pair two edges apart
    assert most_rows(spark, lambda: graphs.hops(edges, roots, 3).collect()) <= max(len(expected), len(two), len(pairs)) < 20 * len(two)


def test_triangle_changes_make_paths_once(spark):
    # paths a, b, c without a third edge, each edge changed at four times
    into = spark.range(30).selectExpr("id AS src", "100L AS dst")
    out = spark.range(30).selectExpr("100L AS src", "200 + id AS dst")
    closing = spark.createDataFrame([(0, 200)], "src long, dst long")
    changes = into.union(out).union(closing).crossJoin(spark.range(4).selectExpr("id AS __t", "1L AS __w"))
    found = []
    assert most_rows(spark, lambda: found.extend(wcoj.triangle_changes(changes).collect())) <= 30 * 30
    assert sorted(map(tuple, found)) == [(0, 100, 200, t, (t + 1) ** 3 - t**3) for t in range(4)]


def test_item_similarity_deals_pairs_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_OF_TASK", 20)
    rows = spark.range(60).selectExpr("id div 6 AS user", "id % 6 AS item")
    found = graphs.item_similarity(rows, 5)
    assert sorted(map(tuple, found.collect())) == [(a, b, 10, 10) for a in range(6) for b in range(a + 1, 6)]
    # 150 pairs
    assert re.search(r"hashpartitioning\(a#\w+, b#\w+, 8\)", found._jdf.queryExecution().executedPlan().toString())
