"""Programs of the language: known results, and memory against DataFrames."""

from __future__ import annotations

import random

import pytest

from deltaspark.functions.hashing import reference_row
from deltaspark.plans.language import Session, evaluate, parse
from deltaspark.plans.language.run import ProgramError, decode_row, delay, encode_row, rows
from deltaspark.plans.language.tree import Many, Variant, order
from deltaspark.sources.inputs import random_rows

#: Friends within some steps of a root, in both ways of writing programs; a person's number is a row's first field.
NEAR = """
let knows = input 0 | key($0[0] ; $0[1]);
let first = input 1 | key($0[0] ; 0);
steps: { var least = first + (least | filter($1[0] < 3) | join(knows, ($2 ; $1[0] + 1))) | min; }
export "near" = steps::least | filter($1[0] > 0);
"""
NEAR_CALLS = """
let knows = MAP(INPUT 0, ($0[0] ; $0[1]));
let first = MAP(INPUT 1, ($0[0] ; 0));
steps: { var least = REDUCE(CONCAT(first, JOIN(FILTER(least, $1[0] < 3), knows, ($2 ; $1[0] + 1))), MIN); }
export "near" = FILTER(steps::least, $1[0] > 0);
"""
#: Powers of two up to a bound, as a loop over numbers; numbers enter late.
DOUBLES = """
grow: { let start = input 0 | key($0[0] ;) | enter_at($0[0]); var all = start + (all | filter($0[0] < 100) | key($0[0] * 2 ;)) | distinct; }
export "all" = grow::all;
"""
#: Auctions: bidders raise a bid by ten while another one holds the lot, up to their limits (lot, bidder, limit).
AUCTION = """
let limits = input 0 | key($0[0] ; $0[2], $0[1]);
let top = limits | key($0 ; 0 - $1[0], $1[1]) | min;
let rest = limits - (top | key($0 ; 0 - $1[0], $1[1]));
let second = rest | key($0 ; 0 - $1[0]) | min;
export "price" = top | join(second, ($0 ; $1[1], 0 - $2[0]));
"""


def nearest(pairs, roots):
    dist, level = dict.fromkeys(roots, 0), set(roots)
    for d in (1, 2, 3):
        level = {b for a, b in pairs if a in level} - set(dist)
        dist |= dict.fromkeys(level, d)
    return {n: d for n, d in dist.items() if d}


def one(found):
    return sorted((tuple(r["key"]), tuple(r["val"]), r["__w"]) for r in found.collect())


@pytest.fixture(scope="module")
def edges(spark):
    return rows(random_rows(spark, 30, 60, seed=9), ["k0", "k1"])


@pytest.mark.parametrize("text", [NEAR, NEAR_CALLS])
@pytest.mark.parametrize("memory", [True, False])
def test_near(spark, edges, text, memory):
    pairs = [reference_row(e, 30, 2, 9) for e in range(60)]
    found = one(evaluate(text, {0: edges, 1: rows(spark.createDataFrame([(pairs[0][0],), (pairs[7][0],)], "n long"), ["n"])}, memory)["near"])
    expected = nearest(pairs, {pairs[0][0], pairs[7][0]})
    assert found == sorted(((n,), (d,), 1) for n, d in expected.items()) and len(found) > 5


@pytest.mark.parametrize("memory", [True, False])
def test_late_entries_change_nothing(spark, memory):
    found = one(evaluate(DOUBLES, {0: rows(spark.createDataFrame([(3,), (7,), (24,)], "n long"), ["n"])}, memory)["all"])
    assert [k[0] for k, _, _ in found] == [3, 6, 7, 12, 14, 24, 28, 48, 56, 96, 112, 192]


@pytest.mark.parametrize("memory", [True, False])
def test_auction(spark, memory):
    rng = random.Random(3)
    bids = [(lot, bidder, 10 * lot + rng.randrange(50) * 7 + bidder) for lot in range(4) for bidder in range(5)]
    found = one(evaluate(AUCTION, {0: rows(spark.createDataFrame(bids, "l long, b long, m long"), ["l", "b", "m"])}, memory)["price"])
    for lot in range(4):
        mine = sorted(((m, b) for x, b, m in bids if x == lot), reverse=True)
        assert ((lot,), (min(b for m, b in mine if m == mine[0][0]), mine[1][0]), 1) in found
    assert len(found) == 4


def test_same_in_memory_and_on_frames(spark):
    text = """
    let a = input 0 | key($0[0] ; $0[1]);
    let b = a | filter($1[0] > 3 && not($0[0] == 2)) | key($0[0] + 1 ; $1, $0[0] * 2 - 1);
    export "min" = a + a | min; export "count" = a + a | key($0[0] ;) | count; export "sub" = a - (a | filter(or($1[0] < 5, $0[0] == 1)));
    export "join" = a | join(b, ($1 ; $2, if($0[0] < 9, 1, 0))); export "b" = b; export "neg" = a | negate | distinct;
    export "wrap" = a | key($0[0] * 4611686018427387904 + $1[0] * 4611686018427387904 ; 0 - $0[0] * 9223372036854775807 - 9223372036854775807);
    """
    table = rows(random_rows(spark, 12, 60, seed=4), ["k0", "k1"])
    small, large, values = evaluate(text, {0: table}, True), evaluate(text, {0: table}), evaluate(text + 'export "x" = a | key(hash(0, $0[0]) ;);', {0: table})
    for name in small:
        assert one(small[name]) == one(large[name]) == one(values[name]) and (name == "neg" or one(small[name])), name


def test_encoded_values_sort_like_them():
    rng = random.Random(5)

    def some(depth):
        kind = rng.randrange(4 if depth else 1)
        if kind == 0:
            return rng.choice((0, 1, -1, 255, -(1 << 63), (1 << 63) - 1, rng.randrange(-9, 9)))
        if kind == 3:
            return Variant((rng.randrange(3), some(depth - 1)))
        return (Many if kind == 2 else tuple)(some(depth - 1) for _ in range(rng.randrange(3)))

    drawn = [tuple(some(3) for _ in range(rng.randrange(3))) for _ in range(400)]
    assert all(decode_row(encode_row(x)) == x and repr(order(decode_row(encode_row(x)))) == repr(order(x)) for x in drawn)
    assert sorted(drawn, key=order) == sorted(drawn, key=encode_row)


@pytest.mark.parametrize("memory", [True, False])
def test_values_and_unnesting(spark, memory):
    text = """
    con Pair(2) = 7; con None(0) = 8;
    let a = input 0 | key($0[0] ; $0[1]);
    let lists = a | collect | key($0 ; fold($1[0], 0, ^0[0] + ^1), len($1[0]));
    let cases = a | key($0 ; if($1[0] > 2, Pair($0[0], $1[0]), None())) | key($0 ; case $1[0] { Pair(x, y) => x * 100 + y, _ => 0 - 1 });
    let flat = a | key($0 ; list($1[0], $0[0])) | flatmap($1[0]) | key($0, $1[0] ; $1[1]);
    export "lists" = lists; export "cases" = cases; export "flat" = flat;
    """
    found = evaluate(text, {0: rows(spark.createDataFrame([(1, 2), (1, 5), (3, 4)], "a long, b long"), ["a", "b"])}, memory)
    assert one(found["lists"]) == [((1,), (7, 2), 1), ((3,), (4, 1), 1)]
    assert one(found["cases"]) == [((1,), (-1,), 1), ((1,), (105,), 1), ((3,), (304,), 1)]
    assert ((1, 1), (1,), 2) in one(found["flat"]) and ((3, 0), (4,), 1) in one(found["flat"])


def test_errors(spark, edges):
    for text in ("let a = ;", "let a = input 0 | nothing(1); export \"r\" = a;", "let a = input 0 | filter($0[0] ==);"):
        with pytest.raises(ValueError):
            parse(text)
    for text in ('export "r" = missing;', 'let a = b; let b = a; export "r" = a;', 'export "r" = input 3;', 'export "r" = input 0 | key($0[9] ;);', 'export "r" = input 0 | key(list($0[0]) ;);', 'export "r" = input 0 | key(tuple(1)[3] ;);'):
        for memory in (True, False):
            with pytest.raises(ProgramError):
                evaluate(text, {0: edges}, memory)


@pytest.mark.parametrize("memory", [True, False])
def test_rounds_as_values(spark, memory):
    """The round in which each number first shows."""
    text = 'grow: { var all = (input 0) + (all | filter($0[0] < 9) | key($0[0] * 3 ;)) | distinct; let when = all | lift_iter; } export "when" = grow::when;'
    inputs = {0: rows(spark.createDataFrame([(1,), (2,)], "n long"), ["n"])}
    assert one(evaluate(text, inputs, memory)["when"]) == [((1,), (1,), 1), ((2,), (1,), 1), ((3,), (2,), 1), ((6,), (2,), 1), ((9,), (3,), 1), ((18,), (3,), 1)]
    with pytest.raises(ProgramError):
        evaluate(text.replace("(input 0) + ", "(input 0) + (when | key($0 ;)) + "), inputs, memory)


def test_delays():
    assert [delay(x) for x in (0, 1, 2, 3, 4, 255)] == [0, 256, 512, 512, 768, 2048]


def test_generated_rows(spark):
    assert [tuple(r) for r in random_rows(spark, 50, 4).collect()] == [(0, 35), (1, 15), (16, 19), (43, 25)]
    assert [tuple(r) for r in random_rows(spark, 9, 50, 3, 7).collect()] == [reference_row(e, 9, 3, 7) for e in range(50)]


def test_session(spark):
    """Stock levels of a shop: deliveries and sales as updates, a second program that imports the first's export."""
    s = Session(spark)
    s.install("stock", 'export "level" = input 0 | key($0[0] ;) | count;')
    s.install("short", 'export "short" = import "level" | filter($1[0] < 3) | key($0 ;);')
    for item, n in ((7, 5), (8, 2)):
        s.feed(0, (item,), weight=n)
    s.tick()
    assert s.peek("level") == [((7,), (5,), 1), ((8,), (2,), 1)] and s.peek("short") == [((8,), (), 1)]
    s.feed(0, (8,), weight=4)
    s.feed(0, (7,), weight=-4, time=2)
    s.tick()
    assert s.peek("short") == []
    s.tick()
    assert s.peek("short") == [((7,), (), 1)]
    with pytest.raises(ValueError):
        s.feed(0, (9,), time=0)
    with pytest.raises(ValueError):
        s.install("other", 'export "level" = input 0;')
    with pytest.raises(ValueError):
        s.drop("stock")
    s.drop("short")
    assert s.list() == {"stock": ["level"]}
    s.install("made", 'export "n" = import "iota:5" | key(;) | count; export "t" = import "clock";')
    s.tick()
    assert s.peek("n") == [((), (5,), 1)] and s.peek("t") == [((3,), (), 1)]
