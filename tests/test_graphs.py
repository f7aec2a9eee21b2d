"""Graph loops against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from deltaspark.operators import graphs, wcoj


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    return sorted({(rng.randrange(18), rng.randrange(18)) for _ in range(30)})


@pytest.fixture(scope="module")
def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def got(df):
    return sorted(map(tuple, df.collect()))


def distances(pairs, root):
    dist, level = {root: 0}, [root]
    while level:
        level = [b for a in level for x, b in pairs if x == a and b not in dist and not dist.__setitem__(b, dist[a] + 1)]
    return dist


def test_bfs_and_reach(spark, edges, pairs):
    root = spark.createDataFrame([(pairs[0][0],)], "node long")
    dist = distances(pairs, pairs[0][0])
    assert got(graphs.bfs(edges, root)) == sorted(dist.items())
    assert got(graphs.reach(edges, root)) == sorted((n,) for n in dist)


def test_bidijkstra(spark, edges, pairs):
    goals = [(a, b) for a in range(0, 18, 6) for b in range(1, 18, 5)]
    expected = sorted((a, b, distances(pairs, a)[b]) for a, b in goals if b in distances(pairs, a))
    assert got(graphs.bidijkstra(edges, spark.createDataFrame(goals, "src long, dst long"))) == expected


def test_strongly_connected(edges, pairs):
    reach = {a: set(distances(pairs, a)) for a, _ in pairs} | {}
    assert got(graphs.strongly_connected(edges)) == [(a, b) for a, b in pairs if a in reach.get(b, ())]


def test_components(edges, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    both = [(a, b) for a in near for b in near[a]]
    assert got(graphs.components(edges)) == sorted((n, min(distances(both, n))) for n in near)


def test_components_of_a_long_path(spark):
    path = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.label for r in graphs.components(path).collect()} == {0}


def test_kcore(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)], "src long, dst long")
    assert got(graphs.kcore(e, 2)) == [(1, 2), (1, 3), (2, 3)]
    assert got(graphs.kcore(e, 3)) == []


def test_triangles_agree(edges, pairs):
    have = set(pairs)
    expected = sorted((a, b, c) for a, b in pairs for x, c in pairs if x == b and (a, c) in have)
    assert got(graphs.triangles(edges)) == got(wcoj.triangles(edges)) == expected


def test_one_triangle(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    assert got(wcoj.triangles(e)) == [(0, 1, 2)]


def test_triangle_changes_add_up(spark):
    rng = random.Random(9)
    updates = [(rng.randrange(6), rng.randrange(6), rng.randrange(4), rng.choice((1, 1, -1))) for _ in range(60)]
    table = spark.createDataFrame(updates, "src long, dst long, __t long, __w long").groupBy("src", "dst", "__t").sum("__w").withColumnRenamed("sum(__w)", "__w").where("__w <> 0")
    changes = wcoj.triangle_changes(table).collect()
    for now in range(4):
        w = defaultdict(int)
        for a, b, t, x in updates:
            w[a, b] += x * (t <= now)
        expected = {(a, b, c): w[a, b] * w[b, c] * w[a, c] for a in range(6) for b in range(6) for c in range(6)}
        found = defaultdict(int)
        for r in changes:
            found[r.a, r.b, r.c] += r["__w"] * (r["__t"] <= now)
        assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v}


def test_colouring(edges, pairs):
    colours = dict(got(graphs.sequence(edges, graphs.least_free)))
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    known = {}
    for n in sorted(near):
        known[n] = graphs.least_free(n, {x: known[x] for x in near[n] if x < n})
    assert colours == known


def test_stable_matching(spark):
    rng = random.Random(1)
    wishes = [(a, p, 100 + b, rng.random()) for a in range(6) for p, b in enumerate(rng.sample(range(5), 4))]
    ranks = sorted(x[3] for x in wishes)
    table = spark.createDataFrame([(a, p, b, ranks.index(r)) for a, p, b, r in wishes], "left long, lpref long, right long, rpref long")
    match = dict(got(graphs.stable_matching(table)))
    assert len(set(match.values())) == len(match)
    back = {b: a for a, b in match.items()}
    for a, p, b, r in wishes:  # nobody prefers somebody who prefers them too
        mine = next((q for x, q, y, _ in wishes if x == a and match.get(a) == y), 99)
        theirs = next((s for x, _, y, s in wishes if y == b and back.get(b) == x), 99)
        assert not (p < mine and r < theirs)


def test_pagerank(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 0)], "src long, dst long")
    rank = {0: 600, 1: 600, 2: 600}
    for _ in range(4):
        rank = {0: 100 + 5 * rank[2] // 6, 1: 100 + 5 * rank[0] // 12, 2: 100 + 5 * rank[0] // 12 + 5 * rank[1] // 6}
    assert dict(got(graphs.pagerank(e, 4, 600, 100))) == rank


def test_identifiers_differ(spark):
    out = graphs.identifiers(spark.range(500).selectExpr("id % 300 AS a", "'x' AS b"))
    assert out.count() == 300 == out.select("id").distinct().count()


def test_attend(spark):
    friends = spark.createDataFrame([(0, 5), (1, 5), (2, 5), (0, 6), (5, 6), (2, 6), (5, 7), (6, 7)], "src long, dst long")
    assert got(graphs.attend(spark.createDataFrame([(0,), (1,), (2,)], "node long"), friends)) == [(0,), (1,), (2,), (5,), (6,)]
