"""Queries over whole tables: nothing is left out of their input, and those without SQL agree with plain Python."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest

from deltaspark.plans import catalogue, graph_queries

FOLDER = "/root/testdata/sf0.001"


def ask(sql):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con.execute(sql).fetchall()


def run(spark, name):
    return sorted(map(tuple, catalogue.QUERIES[name][0](spark, FOLDER).collect()))


@pytest.fixture(scope="module")
def pairs():
    n = ask("SELECT count(*) FROM customer")[0][0]
    return sorted({(a, k * 7919 % n) for k, a in ask("SELECT o_orderkey, o_custkey FROM orders")})


@pytest.fixture(scope="module")
def near(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def test_edges_of_all_orders(spark, pairs):
    assert sorted(map(tuple, graph_queries.edges(spark, FOLDER).collect())) == pairs


def test_dag_of_all_orders(spark):
    rows = ask("SELECT o_orderkey, o_custkey FROM orders")
    expected = sorted({(a + a // 40, a + a // 40 + 1 + k % (40 - a % 40)) for k, a in rows})
    assert sorted(map(tuple, graph_queries.dag(spark, FOLDER).collect())) == expected
    assert all(a < b for a, b in expected) and len({a for a, _ in expected}) == len({a for _, a in rows})


def test_shortest_reaches_most_nodes(spark):
    rows, n = ask("SELECT o_orderkey, o_custkey FROM orders"), ask("SELECT count(*) FROM customer")[0][0]
    expected = sorted({(a, a + 1 + k * 7919 % n) for k, a in rows})
    assert sorted(map(tuple, graph_queries.spread(spark, FOLDER).collect())) == expected
    assert 2 * len(run(spark, "shortest")) > len({x for e in expected for x in e})


def test_strongly_connected(spark, pairs):
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    reached = {}
    for a in list(after):
        seen, todo = set(), [a]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        reached[a] = seen
    assert run(spark, "strongly_connected") == [(a, b) for a, b in pairs if a in reached.get(b, ())]


def test_kcore(spark, near):
    left = {a: set(b) for a, b in near.items()}
    while small := [a for a, b in left.items() if len(b) < 3]:
        for a in small:
            for b in left.pop(a):
                if b in left:
                    left[b].discard(a)
    assert run(spark, "kcore") == sorted((a, b) for a in left for b in left[a] if a < b)


def test_pagerank(spark, pairs):
    after = defaultdict(list)
    for a, b in pairs:
        after[a].append(b)
    nodes = {x for p in pairs for x in p}
    rank = dict.fromkeys(nodes, 6_000_000)
    for _ in range(5):
        new = dict.fromkeys(nodes, 1_000_000)
        for a, to in after.items():
            for b in to:
                new[b] += 5 * rank[a] // (6 * len(to))
        rank = new
    assert run(spark, "pagerank") == sorted(rank.items())


def test_greedy_colouring(spark, near):
    value: dict = {}
    for a in sorted(near):
        value[a] = next(v for v in range(len(near)) if v not in {value.get(b) for b in near[a]})
    assert run(spark, "greedy_colouring") == sorted(value.items())


def friends():
    n = ask("SELECT count(*) FROM customer")[0][0]
    return sorted({(a, k * 31 % n) for k, a in ask("SELECT o_orderkey, o_custkey FROM orders")})


def test_dense_of_all_orders(spark):
    assert sorted(map(tuple, graph_queries.dense(spark, FOLDER).collect())) == friends()


def test_attend(spark):
    organisers = {a for (a,) in ask("SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE'")}
    go, old = organisers, None
    while go != old:
        heard = defaultdict(int)
        for a, b in friends():
            heard[b] += a in go
        old, go = go, organisers | {b for b, n in heard.items() if n >= 3}
    assert run(spark, "attend") == sorted((a,) for a in go) and len(go) > len(organisers)


def test_stable_matching_has_no_blocking_pair(spark):
    wishes = spark.createDataFrame(friends(), "src long, dst long").selectExpr("src", "dst", "xxhash64(src, dst) AS l", "xxhash64(dst, src, 1) AS r").collect()
    rank = {(w.src, w.dst): (w.l, w.r) for w in wishes}
    found = run(spark, "stable_matching")
    left, right = dict(found), {b: a for a, b in found}
    assert len(left) == len(right) == len(found) and all(p in rank for p in found)
    for (a, b), (x, y) in rank.items():
        assert (a in left and rank[a, left[a]][0] <= x) or (b in right and rank[right[b], b][1] <= y)


def test_item_similarity_counts_all_orders(spark):
    orders = defaultdict(set)
    for u, item in ask("SELECT l_orderkey, l_suppkey FROM lineitem"):
        orders[item].add(u)
    both = [(a, b, len(orders[a] & orders[b]), len(orders[a] | orders[b])) for a in orders for b in orders if a < b]
    assert run(spark, "item_similarity") == sorted(x for x in both if x[2] * 100 > x[3] * 2) != []


def test_maintained_join_has_all_users(spark):
    both = "SELECT user_id FROM events WHERE event_type = "
    assert {r[0] for r in catalogue.QUERIES["maintained_join"][0](spark, FOLDER).select("k").collect()} == {k for (k,) in ask(f"{both}'purchase' INTERSECT {both}'click'")}
    assert len(ask(f"SELECT * FROM ({both}'purchase' INTERSECT {both}'click') ORDER BY 1")) > 0


def test_q22_knows_every_urgent_order(spark, tmp_path):
    customers = [(1, 3, 10.0), (2, 3, 90.0), (3, 3, 80.0), (4, 3, 70.0)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(4, 2, "1-URGENT"), (5, 3, "1-URGENT"), (6, 4, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["tpch_q22"][0](spark, str(tmp_path)).collect()
    assert [(r.code, r.n, r.total) for r in got] == [(3, 1, 7000)]


def test_all_nodes_are_goals_roots_and_candidates(spark, pairs):
    after, starts = defaultdict(set), {a for a, _ in pairs}
    for a, b in pairs:
        after[a].add(b)
    least = min(starts)
    dist, level = {least: 0}, {least}
    while level:
        level = {b for a in level for b in after[a]} - set(dist)
        dist |= dict.fromkeys(level, max(dist.values()) + 1)
    assert run(spark, "bidijkstra") == sorted((least, b, n) for b, n in dist.items())
    two = {a: {c for b in after[a] for c in after[b]} for a in starts}
    assert run(spark, "three_hops") == sorted((a, c) for a in starts for c in {z for b in two[a] for z in after[b]})
    assert run(spark, "rules_negation") == sorted((a, c) for a in starts for c in two[a] - after[a])
    g = defaultdict(set)
    for a, b in friends():
        g[a].add(b)
    assert run(spark, "pattern_wcoj") == sorted((a, b, c, e) for a in list(g) for b in list(g[a]) for c in list(g[b]) for e in g[c] & g[a])
