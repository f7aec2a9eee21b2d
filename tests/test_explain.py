"""Explanations: the rows found give the wanted rows again, and no row is found without a reason."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from deltaspark.plans.language import evaluate, explain
from deltaspark.plans.language.run import ProgramError, rows
from deltaspark.plans.language_queries import REACH

WEIGHTED = "key array<long>, val array<long>, __w long"
#: Hops from the roots.
HOPS = """
let links = input 0 | key($0[0] ; $0[1]);
walk: { let start = input 1 | key($0[0] ; 0); var least = start + (least | join(links, ($2 ; $1[0] + 1))) | min; }
export "far" = walk::least | filter($1[0] > 1);
"""
#: Links whose end isn't reached over other links but those that lead back.
LONE = """
let links = input 0 | distinct;
let both = links | join(links | key($0[1], $0[0] ;) | distinct, ($0 ;)) | distinct;
let oneway = (links - both) | key($0[0] ; $0[1]);
walk: { var seen = (input 1) + (seen | join(oneway, ($2 ;))) | distinct; }
let ends = input 0 | key($0[1] ;) | distinct;
export "lone" = (ends - (ends | join(walk::seen, ($0 ;)))) | distinct;
"""
#: Rounds of taking away nodes without incoming links, by loops in a loop.
CYCLES = """
let links = input 0 | key($0[0] ; $0[1]);
outer: {
  inner: { var live = (input 1) + (live | join(links, ($2 ;))) | distinct; }
  var keep = links | join(inner::live | key($0 ;), ($1 ; $0)) | key($0 ;) | count | key($0 ; $1);
}
export "in" = outer::keep;
"""
#: Lists made and taken apart; rows enter late.
LISTS = """
let links = input 0 | key($0[0] ; $0[1]) | enter_at($1[0]);
let spread = links | collect | flatmap($1[0]) | key($1[1][0] ; $0[0], $1[0]);
export "spread" = spread | filter($1[1] < 2);
"""


def table(spark, seed, nodes=10, links=20):
    rng = random.Random(seed)
    made = [([rng.randrange(nodes), rng.randrange(nodes)], [], rng.choice((1, 1, 2))) for _ in range(links)]
    return spark.createDataFrame(made, WEIGHTED)


def content(df):
    return {(tuple(r["key"]), tuple(r["val"])): r["__w"] for r in df.groupBy("key", "val").agg(F.sum("__w").alias("__w")).collect() if r["__w"]}


def cut_down(inputs, found):
    return {x: df.join(found[x].select("key", "val").distinct(), ["key", "val"], "left_semi") if x in found else df for x, df in inputs.items()}


def test_reach_needs_the_first_ways_only(spark):
    links = table(spark, 1, 20, 45)
    inputs = {0: links, 1: rows(spark.createDataFrame([(links.first()["key"][0],)], "n long"), ["n"])}
    pairs = {k for k, _ in content(links)}
    root = links.first()["key"][0]
    dist, level = {root: 0}, {root}
    while level:
        level = {b for a, b in pairs if a in level} - set(dist)
        dist |= dict.fromkeys(level, max(dist.values()) + 1)
    first = {(a, b) for a, b in pairs if a in dist and dist[b] == dist[a] + 1}
    goals = sorted(dist, key=dist.get)[-3:]
    asked = spark.createDataFrame([([g], [], i) for i, g in enumerate(goals)] + [([99], [], 7)], "key array<long>, val array<long>, q long")
    found = explain(REACH, inputs, {"result": asked})
    want = set()
    for i, goal in enumerate(goals):
        ends = {goal}
        while ends:
            ways = {(a, b) for a, b in first if b in ends}
            want |= {(*w, i) for w in ways}
            ends = {a for a, _ in ways}
    assert {(*r["key"], r["q"]) for r in found[0].collect()} == want and dist[goals[-1]] > 2
    assert {(r["key"][0], r["q"]) for r in found[1].collect()} == {(root, i) for i in range(3)}


@pytest.mark.parametrize("text, export, seed", [(HOPS, "far", 4), (LONE, "lone", 9), (CYCLES, "in", 9), (LISTS, "spread", 2)])
def test_rows_found_suffice(spark, text, export, seed):
    """Each wanted row by itself, and others are at liberty to differ."""
    links = table(spark, seed)
    inputs = {0: links, 1: rows(links.limit(2).select(F.col("key")[0].alias("n")), ["n"])}
    inputs = {x: df for x, df in inputs.items() if x == 0 or "input 1" in text}
    whole = content(evaluate(text, inputs, memory=True)[export])
    assert whole
    wanted = random.Random(seed).sample(sorted(whole), min(2, len(whole)))
    found = explain(text, inputs, {export: spark.createDataFrame([(list(k), list(v)) for k, v in wanted], "key array<long>, val array<long>")})
    again = content(evaluate(text, cut_down(inputs, found), memory=True)[export])
    assert {x: again.get(x) for x in wanted} == {x: whole[x] for x in wanted}
    assert all(found[x].join(df, ["key", "val"], "left_anti").isEmpty() for x, df in inputs.items())


def test_subtracted_rows_are_found_where_they_matter(spark):
    """2 is taken away, so that 3 is the least; if 2 is held for another reason, what takes it away is needed, too."""
    text = 'let rest = (input 0 | distinct) - (input 1 | distinct); export "least" = rest | key( ; $0) | min; export "two" = input 0 | filter($0[0] == 2);'
    number = lambda *n: rows(spark.createDataFrame([(x,) for x in n], "n long"), ["n"])
    inputs, row = {0: number(2, 3, 9), 1: number(2, 5)}, "key array<long>, val array<long>"
    found = explain(text, inputs, {"least": spark.createDataFrame([([], [3])], row)})
    assert [r["key"] for r in found[0].collect()] == [[3]] and found[1].isEmpty()
    found = explain(text, inputs, {"least": spark.createDataFrame([([], [3])], row), "two": None})
    assert sorted(r["key"] for r in found[0].collect()) == [[2], [3]] and [r["key"] for r in found[1].collect()] == [[2]]


def test_nothing_wanted_and_refusals(spark):
    inputs = {0: table(spark, 5), 1: rows(spark.createDataFrame([(1,)], "n long"), ["n"])}
    none = spark.createDataFrame([([77], []), (None, [])], "key array<long>, val array<long>")
    assert all(df.isEmpty() for df in explain(REACH, inputs, {"result": none}).values())
    with pytest.raises(ProgramError):
        explain(REACH, inputs, {"other": none})
    with pytest.raises(ProgramError):
        explain(REACH, {0: inputs[0]}, {"result": none})
    lifted = 'grow: { var all = (input 0) + all | distinct; let when = all | lift_iter; } export "when" = grow::when;'
    some = evaluate(lifted, {0: inputs[0]})["when"]
    with pytest.raises(ProgramError):
        explain(lifted, {0: inputs[0]}, {"when": some})
