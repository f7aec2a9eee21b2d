"""Graph queries over edge tables made from the orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, wcoj
from .relational import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: Edge tables from all orders. A cyclic directed graph over customers, the same in SQL.
_EDGES = "e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7919) % (SELECT count(*) FROM customer) AS dst FROM orders)"
#: An acyclic one whose first node reaches most others.
_SPREAD = "d AS (SELECT DISTINCT o_custkey AS src, o_custkey + 1 + (o_orderkey * 7919) % (SELECT count(*) FROM customer) AS dst FROM orders)"
#: One with closures that grow like the table: each 40 customers get 41 nodes of their own, edges go to later nodes of the same 41.
_DAG = "d AS (SELECT DISTINCT o_custkey + o_custkey // 40 AS src, o_custkey + o_custkey // 40 + 1 + o_orderkey % (40 - o_custkey % 40) AS dst FROM orders)"
#: One with triangles.
_DENSE = "g AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 31) % (SELECT count(*) FROM customer) AS dst FROM orders)"


def _hashed(spark, d, factor: int, shift=None):
    """Edges from each order's customer to a customer number made of the order's key."""
    n = table(spark, d, "customer").count()
    to = (F.col("o_orderkey") * factor) % n
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (to if shift is None else F.col(shift) + 1 + to).alias("dst")).distinct()


def edges(spark, d):
    return _hashed(spark, d, 7919)


def spread(spark, d):
    return _hashed(spark, d, 7919, "o_custkey")


def dag(spark, d):
    rows = table(spark, d, "orders").withColumn("src", F.expr("o_custkey + o_custkey div 40"))
    return rows.select("src", F.expr("src + 1 + o_orderkey % (40 - o_custkey % 40)").alias("dst")).distinct()


def dense(spark, d):
    return _hashed(spark, d, 31)


def least(e):
    return e.agg(F.min("src").alias("node"))


_REACH = "r AS (SELECT min(src) AS node FROM e UNION SELECT dst FROM r JOIN e ON src = node)"


@query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT node FROM r")
def reach(spark, d):
    e = edges(spark, d)
    return graphs.reach(e, least(e))


_BFS = "b AS (SELECT min(src) AS node, 0::BIGINT AS dist FROM e UNION SELECT dst, dist + 1 FROM b JOIN e ON src = node WHERE dist < 60)"


@query(f"WITH RECURSIVE {_EDGES}, {_BFS} SELECT node, min(dist) AS dist FROM b GROUP BY 1")
def bfs(spark, d):
    e = edges(spark, d)
    return graphs.bfs(e, least(e))


@query(f"WITH RECURSIVE {_EDGES}, {_BFS}, m AS (SELECT node, min(dist) AS hops FROM b GROUP BY 1) SELECT (SELECT min(src) FROM e) AS src, node AS dst, hops FROM m")
def bidijkstra(spark, d):
    """All nodes are goals."""
    e = edges(spark, d)
    nodes = e.select(F.col("src").alias("dst")).unionByName(e.select("dst")).distinct()
    return graphs.bidijkstra(e, nodes.crossJoin(F.broadcast(e.agg(F.min("src").alias("src")))))


@query(f"""WITH RECURSIVE {_SPREAD}, w AS (SELECT src, dst, (src + dst) % 17 + 1 AS weight FROM d),
 s AS (SELECT min(src) AS node, 0::BIGINT AS dist FROM w UNION SELECT w.dst, dist + weight FROM s JOIN w ON src = node) SELECT node, min(dist) AS dist FROM s GROUP BY 1""")
def shortest(spark, d):
    e = spread(spark, d).withColumn("weight", F.expr("(src + dst) % 17 + 1"))
    return graphs.shortest(e, least(e))


@query(f"""WITH RECURSIVE {_DAG}, s AS (SELECT src AS a, dst AS b FROM d UNION SELECT dst, src FROM d),
 r AS (SELECT DISTINCT a AS node, a AS label FROM s UNION SELECT b, label FROM r JOIN s ON a = node) SELECT node, min(label) AS label FROM r GROUP BY 1""")
def connected_components(spark, d):
    return graphs.components(dag(spark, d))


@query(f"WITH RECURSIVE {_DAG}, r AS (SELECT DISTINCT src AS node, src AS label FROM d UNION SELECT dst, label FROM r JOIN d ON src = node) SELECT node, min(label) AS label FROM r GROUP BY 1")
def propagate(spark, d):
    e = dag(spark, d)
    return graphs.propagate(e, e.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct())


@query(f"WITH RECURSIVE {_EDGES}, t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src) SELECT e.src, e.dst FROM e JOIN t ON t.src = e.dst AND t.dst = e.src UNION SELECT src, dst FROM e WHERE src = dst")
def strongly_connected(spark, d):
    return graphs.strongly_connected(edges(spark, d))


@query(f"WITH RECURSIVE {_DAG}, t AS (SELECT src, dst FROM d UNION SELECT t.src, d.dst FROM t JOIN d ON t.dst = d.src) SELECT src, dst FROM t")
def transitive_closure(spark, d):
    return graphs.closure(dag(spark, d))


@query(f"""WITH RECURSIVE {_DAG}, s AS (SELECT x.dst AS a, y.dst AS b FROM d x JOIN d y ON x.src = y.src WHERE x.dst <> y.dst
 UNION SELECT x.dst, y.dst FROM s JOIN d x ON x.src = a JOIN d y ON y.src = b WHERE x.dst <> y.dst) SELECT a, b FROM s""")
def same_generation(spark, d):
    return graphs.same_generation(dag(spark, d))


@query(f"WITH {_DENSE} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM g x JOIN g y ON x.dst = y.src JOIN g z ON z.src = x.src AND z.dst = y.dst")
def triangles(spark, d):
    return graphs.triangles(dense(spark, d))


@query(QUERIES["triangles"][1])
def triangles_wcoj(spark, d):
    return wcoj.triangles(dense(spark, d))


@query(f"""WITH {_DENSE} SELECT w.src AS a, w.dst AS b, x.dst AS c, y.dst AS e FROM g w JOIN g x ON w.dst = x.src JOIN g y ON x.dst = y.src
 JOIN g z ON z.src = w.src AND z.dst = y.dst""")
def pattern_wcoj(spark, d):
    """A four-cycle with one edge turned, from a pattern."""
    g = dense(spark, d)
    return wcoj.pattern([(g, "a", "b"), (g, "b", "c"), (g, "c", "e"), (g, "a", "e")], ["a", "b", "c", "e"])


@query("""WITH g AS (SELECT o_custkey AS src, (o_orderkey * 31) % (SELECT count(*) FROM customer) AS dst, o_orderkey % 5 AS t, count(*) AS w FROM orders GROUP BY 1, 2, 3)
 SELECT x.src AS a, x.dst AS b, y.dst AS c, greatest(x.t, y.t, z.t) AS t, sum(x.w * y.w * z.w)::BIGINT AS w
 FROM g x JOIN g y ON x.dst = y.src JOIN g z ON z.src = x.src AND z.dst = y.dst GROUP BY 1, 2, 3, 4""")
def triangles_delta(spark, d):
    """All changes of the triangles, by delta queries."""
    n = table(spark, d, "customer").count()
    src, dst, t = F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31) % n).alias("dst"), (F.col("o_orderkey") % 5).alias("__t")
    g = table(spark, d, "orders").groupBy(src, dst, t).agg(F.count(F.lit(1)).alias("__w"))
    return wcoj.triangle_changes(g).withColumnsRenamed({"__t": "t", "__w": "w"})


@query(f"WITH {_EDGES}, r AS (SELECT DISTINCT src AS root FROM e) SELECT DISTINCT root, z.dst AS node FROM r JOIN e x ON x.src = root JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst")
def three_hops(spark, d):
    e = edges(spark, d)
    return graphs.hops(e, e.select(F.col("src").alias("node")).distinct(), 3)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS item, l_orderkey AS u FROM lineitem), n AS (SELECT item, count(*) AS n FROM p GROUP BY 1),
 m AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM p x JOIN p y ON x.u = y.u AND x.item < y.item GROUP BY 1, 2)
 SELECT a, b, k::BIGINT AS shared, (na.n + nb.n - k)::BIGINT AS total FROM m JOIN n na ON na.item = a JOIN n nb ON nb.item = b WHERE k * 100 > (na.n + nb.n - k) * 2""")
def item_similarity(spark, d):
    return graphs.item_similarity(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("user"), F.col("l_suppkey").alias("item")), 2)


@query(None)
def kcore(spark, d):
    return graphs.kcore(edges(spark, d), 3)


@query(None)
def pagerank(spark, d):
    return graphs.pagerank(edges(spark, d), 5)


@query(None)
def attend(spark, d):
    """The customers of one market segment organise."""
    organisers = table(spark, d, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("node"))
    return graphs.attend(organisers, dense(spark, d))


@query(None)
def stable_matching(spark, d):
    g = dense(spark, d)
    ranked = g.select(F.col("src").alias("left"), F.expr("xxhash64(src, dst)").alias("lpref"), F.col("dst").alias("right"), F.expr("xxhash64(dst, src, 1)").alias("rpref"))
    return graphs.stable_matching(ranked)


@query(None)
def greedy_colouring(spark, d):
    return graphs.sequence(edges(spark, d), graphs.least_free)


@query(None)
def identifiers(spark, d):
    return graphs.identifiers(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"))


@query(QUERIES["transitive_closure"][1])
def rules_closure(spark, d):
    from . import datalog

    return datalog.run(["path(x, y) :- e(x, y)", "path(x, z) :- path(x, y), e(y, z)"], {"e": dag(spark, d)})["path"].toDF("src", "dst")


@query(f"WITH {_EDGES} SELECT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src EXCEPT SELECT src, dst FROM e")
def rules_negation(spark, d):
    """Ends of two edges in a row that no edge joins, by rules with negation."""
    from . import datalog

    rules = ["two(x, z) :- e(x, y), e(y, z)", "open(x, z) :- two(x, z), !e(x, z)"]
    return datalog.run(rules, {"e": edges(spark, d)})["open"].toDF("src", "dst")


@query(f"""WITH RECURSIVE {_DAG}, n AS (SELECT src, dst FROM d WHERE (src + dst) % 2 = 0
 UNION SELECT n.src, d.dst FROM n JOIN d ON n.dst = d.src AND (d.src + d.dst) % 2 = 1) SELECT src, dst, 'N' AS label FROM n""")
def grammar_paths(spark, d):
    """Paths of one edge `a` and any number of edges `b`, by production rules."""
    from . import grammar

    labelled = dag(spark, d).withColumn("label", F.expr("if((src + dst) % 2 = 0, 'a', 'b')"))
    return grammar.run(labelled, "N a\nN N b")
