from __future__ import annotations

import random

import pytest

from deltaspark.plans import grammar


def brute(edges, productions):
    nodes = {x for a, b, _ in edges for x in (a, b)}
    known, size = set(edges), -1
    while len(known) != size:
        size = len(known)
        for head, body in productions:
            ends = {(n, n) for n in nodes}
            for symbol, back in body:
                step = {(b, a) if back else (a, b) for a, b, s in known if s == symbol}
                ends = {(a, d) for a, b in ends for c, d in step if b == c}
            known |= {(a, b, head) for a, b in ends}
    return known


@pytest.mark.parametrize("text", ["N a\nN N b  # a tail of b", "S ~a a\nS ~a S a", "E\nE E b\nP E ~a"])
def test_against_brute_force(spark, text):
    rng = random.Random(3)
    edges = sorted({(x, rng.randrange(x + 1, 9), rng.choice("ab")) for x in range(8) for _ in range(2)} | {(0, 3, "S")})
    productions = grammar.parse(text)
    heads = {h for h, _ in productions}
    got = grammar.run(spark.createDataFrame(edges, "src long, dst long, label string"), text)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {e for e in brute(edges, productions) if e[2] in heads}


def test_errors():
    with pytest.raises(ValueError):
        grammar.parse("~N a")
