"""Operators on collections: identities, small known results, and histories against every moment."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deltaspark.collection import T, W, Collection
from deltaspark.operators.upsert import from_upserts
from deltaspark.sources import cdc
from deltaspark.sources.inputs import InputSession, delimited, facts, labelled_edges, text_edges


def rows(c):
    return sorted((*[r[x] for x in c.data], r[W]) for r in c.consolidate().df.collect())


@pytest.fixture(scope="module")
def numbers(spark):
    return Collection.of(spark.range(1, 11).withColumnRenamed("id", "x"))


def test_identities(numbers):
    odds, evens = numbers.filter("x % 2 = 1"), numbers.filter("x % 2 = 0")
    odds.concat(evens).assert_eq(numbers)
    odds.negate().concat(numbers).assert_eq(evens)
    numbers.subtract(numbers).assert_empty()
    numbers.concat(numbers).distinct().assert_eq(numbers)
    numbers.map((F.col("x") + 1).alias("x")).filter("x <= 10").assert_eq(numbers.filter("x > 1"))
    assert rows(numbers.explode(9 - F.col("x"), "x"))[-1] == (10, -1)
    assert rows(numbers.explode("x").count("n", [])) == [(55, 1)]
    with pytest.raises(AssertionError):
        numbers.assert_empty()


def weighted(rng, size, *bounds):
    return [(*(rng.randrange(b) for b in bounds), rng.choice((1, 2, -1))) for _ in range(size)]


def summed(rows_):
    out = Counter()
    for *row, w in rows_:
        out[tuple(row)] += w
    return sorted((*row, w) for row, w in out.items() if w)


def test_joins_multiply_weights(spark):
    rng = random.Random(11)
    left, right = weighted(rng, 40, 6, 4), weighted(rng, 30, 6, 3)
    a = Collection(spark.createDataFrame(left, f"k long, v long, {W} long"))
    b = Collection(spark.createDataFrame(right, f"k long, c long, {W} long"))
    assert rows(a.join(b, ["k"])) == summed((k, v, c, w * x) for k, v, w in left for j, c, x in right if j == k)
    keys = [(k, x) for k, _, x in right]
    semi = [(k, v, w * x) for k, v, w in left for j, x in keys if j == k]
    held = b.map("k")
    assert rows(a.semijoin(held, ["k"])) == summed(semi)
    assert rows(a.antijoin(held, ["k"])) == summed([*left, *((k, v, -w) for k, v, w in semi)])
    present = {k for k, _ in summed(keys)}
    assert rows(a.semijoin(held.distinct(), ["k"])) == summed(x for x in left if x[0] in present)
    assert rows(a.antijoin(held.distinct(), ["k"])) == summed(x for x in left if x[0] not in present)
    assert held.distinct().unit and not held.unit


def test_general_reduction(spark):
    """Any function of a key's values: here the median value, as often as there are different ones."""
    rng = random.Random(12)
    data = weighted(rng, 60, 5, 9)
    median = lambda key, values: [(values[len(values) // 2][0], len(values))]
    out = Collection(spark.createDataFrame(data, f"k long, v long, {W} long")).reduce(["k"], ["v"], median, "v long")
    by = {}
    for k, v, _ in summed(data):
        by.setdefault(k, []).append(v)
    assert rows(out) == sorted((k, vs[len(vs) // 2], len(vs)) for k, vs in by.items())


def test_distinct_maps_any_weight_to_one(spark):
    table = Collection.from_raw(spark, [(1, 0, 5), (2, 0, -3), (3, 0, 1), (3, 0, -1)], "x long").snapshot(0)
    assert rows(table.distinct()) == [(1, 1), (2, 1)]
    assert rows(table.threshold(lambda w: F.abs(w))) == [(1, 5), (2, 3)]


@pytest.fixture(scope="module")
def changes(spark):
    rng = random.Random(3)
    return Collection.from_raw(spark, [(rng.randrange(8), rng.randrange(4), rng.randrange(6), rng.choice((1, 1, -1))) for _ in range(200)], "k long, v long")


def test_histories_agree_at_every_time(changes):
    """What a reduction of the history accumulates to is the reduction of the accumulated history."""
    smallest = lambda key, values: [(values[0][0], 1)]
    whole = {
        "count": changes.map("k").count("n"),
        "distinct": changes.distinct(),
        "threshold": changes.threshold(lambda w: F.greatest(w, F.lit(0))),
        "reduce": changes.reduce(["k"], ["v"], smallest, "v long"),
        "join": changes.join(changes.map("k", F.col("v").alias("v2")), ["k"]),
    }
    for t in range(6):
        now = changes.snapshot(t)
        expected = {
            "count": now.map("k").count("n"),
            "distinct": now.distinct(),
            "threshold": now.threshold(lambda w: F.greatest(w, F.lit(0))),
            "reduce": now.reduce(["k"], ["v"], smallest, "v long"),
            "join": now.join(now.map("k", F.col("v").alias("v2")), ["k"]),
        }
        for name, history in whole.items():
            assert rows(history.snapshot(t)) == rows(expected[name]), (name, t)


def test_time(spark):
    c = Collection.from_raw(spark, [(1, 2, 0, 1), (2, 3, 1, 1), (2, 3, 2, -1)], "a long, b long")
    assert rows(c.snapshot(1)) == [(1, 2, 1), (2, 3, 1)] and rows(c.snapshot(2)) == [(1, 2, 1)]
    assert sorted(r[T] for r in c.compact(1).df.collect()) == [1, 1, 2]
    assert rows(c.compact(2).snapshot(2)) == rows(c.snapshot(2))
    assert c.epochs() == [0, 1, 2]
    moments = c.differentiate()
    assert sorted((r.a, r[T], r[W]) for r in moments.consolidate().df.collect()) == [(1, 0, 1), (1, 1, -1), (2, 1, 1), (2, 2, -2), (2, 3, 1)]
    assert sorted((r.a, r[T], r[W]) for r in moments.integrate(10).df.collect()) == [(1, 0, 1), (2, 1, 1), (2, 2, -1)]
    assert sorted((r.a, r[T]) for r in c.delay(F.col(T) * 10).df.collect()) == [(1, 0), (2, 10), (2, 20)]


def held_values(events):
    """Changes (time, weight, key, value) of a dict that events (key, value, time) set and delete."""
    out, now = [], {}
    for time in sorted({t for _, _, t in events}):
        for key in sorted({k for k, _, t in events if t == time}):
            new = max((v for k, v, t in events if (k, t) == (key, time) and v is not None), default=None)
            old = now.get(key)
            if new != old:
                out += [(time, w, key, v) for w, v in ((-1, old), (1, new)) if v is not None]
            now[key] = new
    return sorted(out)


def test_upserts(spark):
    rng = random.Random(13)
    events = [(rng.choice("abc"), rng.choice((None, "p", "q", "r")), rng.randrange(12)) for _ in range(40)]
    out = from_upserts(spark.createDataFrame(events, f"key string, val string, {T} long"), ["key"], "val")
    assert sorted((r[T], r[W], r.key, r.val) for r in out.df.collect()) == held_values(events)


def test_input_session(spark):
    s = InputSession(spark, "x long")
    s.insert((1,))
    s.update_at((2,), 3, 5)
    s.advance_to(1)
    s.remove((1,))
    assert rows(s.complete().snapshot(9)) == [(1, 1)]
    with pytest.raises(ValueError):
        s.update_at((1,), 0)
    with pytest.raises(ValueError):
        s.advance_to(0)
    s.advance_to(4)
    s.close()
    assert rows(s.to_collection().snapshot(9)) == [(2, 5)]
    with pytest.raises(ValueError):
        s.insert((1,))


def test_change_protocol(spark, tmp_path, changes):
    folder = f"file://{tmp_path}/cdc"
    for lower, upper in ((2, 4), (0, 2), (0, 2)):
        cdc.write(changes, folder, lower, upper)
    got = cdc.read(spark, folder)
    want = changes.consolidate().filter(F.col(T) < 4)
    assert sorted(map(tuple, got.df.select("k", "v", T, W).collect())) == sorted(map(tuple, want.df.select("k", "v", T, W).collect()))
    updates, progress = spark.read.parquet(f"{folder}/updates"), spark.read.parquet(f"{folder}/progress")
    lost = updates.where(f"NOT ({T} = 1 AND k = 3)")
    assert cdc.frontier(lost.distinct(), progress) == 1
    assert cdc.frontier(updates.distinct(), progress.where("lower > 0")) == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# a comment\n1 2\n3\t4\n\n5  6\n")
    assert sorted(map(tuple, text_edges(spark, str(tmp_path / "g.txt")).collect())) == [(1, 2), (3, 4), (5, 6)]
    (tmp_path / "l.txt").write_text("1 2 n\n2 3 e\n")
    assert labelled_edges(spark, str(tmp_path / "l.txt")).where("label = 'e'").count() == 1
    (tmp_path / "n.tbl").write_text("1|X|2.5|\n2|Y|3.5|\n")
    assert [tuple(r) for r in delimited(spark, str(tmp_path / "n.tbl"), "a long, b string, c double").collect()] == [(1, "X", 2.5), (2, "Y", 3.5)]
    (tmp_path / "f.facts").write_text("m\tn\nm\tn\n")
    assert facts(spark, str(tmp_path / "f.facts"), "a", "b").count() == 1


def test_lookup(spark):
    data = Collection.from_raw(spark, [("a", 1, 0, 1), ("a", 1, 2, -1), ("a", 2, 1, 2)], "k string, v long")
    asked = Collection.from_raw(spark, [("a", 1, 1), ("a", 2, 1)], "k string")
    assert sorted((r[T], r.v, r[W]) for r in data.lookup(asked, ["k"]).df.collect()) == [(1, 1, 1), (1, 2, 2), (2, 2, 2)]


def test_arranged_is_the_same(changes):
    held = changes.arrange(["k"])
    assert rows(held) == rows(changes)
    held.release()


def test_reduction_that_sees_its_output(changes):
    """Each key's greatest value ever: output is only replaced by something greater, and goes with the last value."""

    def highest(key, values, output):
        top = max((v[0] for v, _ in values), default=None)
        held = output[0][0][0] if output else None
        if top is None or held is not None and top <= held:
            return [((held,), -1)] if top is None and output else []
        return [((top,), 1)] + ([((held,), -1)] if output else [])

    schema = f"high {dict(changes.df.dtypes)[changes.data[1]]}"
    got = changes.reduce([changes.data[0]], [changes.data[1]], highest, schema, feedback=True)
    held, out = {}, {}
    updates = sorted((r[T], r[changes.data[0]], r[changes.data[1]], r[W]) for r in changes.consolidate().df.collect())
    for time in range(updates[-1][0] + 1):
        for t, k, v, w in updates:
            if t == time:
                held[k, v] = held.get((k, v), 0) + w
        for k in {k for k, _ in held}:
            now = [v for (x, v), w in held.items() if x == k and w]
            if now:
                out[k] = max(now) if k not in out else max(out[k], max(now))
            else:
                out.pop(k, None)
        assert rows(got.snapshot(time)) == sorted((k, v, 1) for k, v in out.items())


def test_threshold_by_old_and_new_weight(changes):
    """Changes by old and new weight give distinct, whose changes accumulate to it at every time."""
    step = lambda new, old: F.when(old.isNull(), 1).when(new == 0, -1).otherwise(0)
    changes.threshold_changes(step).assert_eq(changes.distinct())
    now = changes.snapshot(3)
    now.threshold_changes(step).assert_eq(now.distinct())


def test_protocol_followed_over_several_calls(spark, tmp_path):
    folder, out = f"file://{tmp_path}/cdc", f"file://{tmp_path}/out"
    rng = random.Random(8)
    whole = Collection(spark.createDataFrame([(rng.randrange(5), rng.randrange(9), 1) for _ in range(60)], f"x long, {T} long, {W} long"))
    cdc.write(whole, folder, 3, 6)
    assert cdc.follow(spark, folder, "x long", out) == (0, 0)
    cdc.write(whole, folder, 0, 3)
    cdc.write(whole, folder, 0, 3)
    assert cdc.follow(spark, folder, "x long", out) == (0, 6)
    assert cdc.follow(spark, folder, "x long", out) == (6, 6)
    (tmp_path / "out" / "until=8").mkdir()  # broken off: it has no mark of completion
    cdc.write(whole, folder, 6, 8)
    assert cdc.follow(spark, folder, "x long", out) == (6, 8)
    cdc.followed(spark, "x long", out).assert_eq(whole.filter(F.col(T) < 8))


def test_protocol_as_streams(spark, tmp_path):
    folder, out, inbox = (f"file://{tmp_path}/{x}" for x in ("cdc", "out", "in"))
    for i in range(3):
        spark.createDataFrame([(i, 1), (7, 2)], f"x long, {W} long").coalesce(1).write.mode("append").parquet(inbox)
    changes = spark.readStream.schema(f"x long, {W} long").option("maxFilesPerTrigger", 1).parquet(inbox)
    for _ in range(2):
        cdc.sink(changes, folder, f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
        cdc.source(spark, folder, "x long", out, f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
        got = cdc.followed(spark, "x long", out)
        assert got.epochs() == [0, 1, 2] and rows(Collection(got.df.drop(T))) == [(0, 1), (1, 1), (2, 1), (7, 6)]
