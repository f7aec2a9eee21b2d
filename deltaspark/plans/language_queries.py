"""Programs of the language over edge tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .graph_queries import QUERIES as GRAPHS
from .graph_queries import _BFS, _DENSE, _EDGES, dag, dense, edges, least
from .language.explanation import explain
from .language.run import evaluate, rows

QUERIES: dict[str, tuple] = {}

REACH = """
let edges = input 0 | key($0[0] ; $0[1]);
reach: { var seen = (input 1) + (seen | join(edges, ($2 ;))) | distinct; }
export "result" = reach::seen;
"""
CLOSURE = """
let edges = input 0 | key($0[0] ; $0[1]);
closure: { var paths = (input 0) + (paths | key($0[1] ; $0[0]) | join(edges, ($1, $2 ;))) | distinct; }
export "result" = closure::paths;
"""
#: For each node, with how many others it has edges both ways, and the total of their numbers.
MUTUAL = """
let forth = input 0 | key($0[0], $0[1] ;);
let back = input 0 | key($0[1], $0[0] ;);
let pairs = forth | join(back, ($0 ;)) | filter($0[0] != $0[1]) | key($0[0] ; $0[1]);
let sums = pairs | collect | key($0 ; len($1[0]), fold($1[0], 0, ^0[0] + ^1));
export "result" = sums;
"""
DEGREES = """
let degrees = input 0 | key($0[0] ; $0[1]) | count;
export "result" = degrees | key($1[0] ; $0[0]) | count;
"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("program_reach", GRAPHS["reach"][1])
def reach(spark, d):
    e = edges(spark, d)
    return evaluate(REACH, {0: rows(e, ["src", "dst"]), 1: rows(least(e), ["node"])})["result"].select(F.col("key")[0].alias("node"))


@query("program_closure", GRAPHS["transitive_closure"][1])
def closure(spark, d):
    return evaluate(CLOSURE, {0: rows(dag(spark, d), ["src", "dst"])})["result"].select(F.col("key")[0].alias("src"), F.col("key")[1].alias("dst"))


@query("program_mutual", f"WITH {_EDGES} SELECT x.src AS node, count(*)::BIGINT AS n, sum(x.dst)::BIGINT AS total FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY 1")
def mutual(spark, d):
    """Lists and folds on whole tables."""
    found = evaluate(MUTUAL, {0: rows(edges(spark, d), ["src", "dst"])})["result"]
    return found.select(F.col("key")[0].alias("node"), F.col("val")[0].alias("n"), F.col("val")[1].alias("total"))


@query("program_degrees", f"WITH {_DENSE} SELECT deg, count(*)::BIGINT AS n FROM (SELECT src, count(*) AS deg FROM g GROUP BY 1) GROUP BY 1")
def degrees(spark, d):
    found = evaluate(DEGREES, {0: rows(dense(spark, d), ["src", "dst"])})["result"]
    return found.select(F.col("key")[0].alias("deg"), F.col("val")[0].alias("n"))



@query(
    "explain_reach",
    f"WITH RECURSIVE {_EDGES}, {_BFS}, m AS (SELECT node, min(dist) AS dist FROM b GROUP BY 1) "
    "SELECT e.src, e.dst FROM e JOIN m x ON x.node = e.src JOIN m y ON y.node = e.dst WHERE y.dist = x.dist + 1",
)
def explained(spark, d):
    """The edges that the nodes found by program_reach need: all first ways to them."""
    e = edges(spark, d)
    inputs = {0: rows(e, ["src", "dst"]), 1: rows(least(e), ["node"])}
    found = explain(REACH, inputs, {"result": None})[0]
    return found.select(F.col("key")[0].alias("src"), F.col("key")[1].alias("dst"))
