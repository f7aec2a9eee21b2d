"""Graph algorithms over edge tables (src, dst: long).

All are loops of joins and aggregations whose state is a table after each round;
none collects the graph or works on it in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce as fold

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, tasks_for
from .loops import iterate, seminaive

# Surfers that a node starts with and gets in each round, and the share of a node's surfers that move on.
SURFERS, FRESH = 6_000_000, 1_000_000
MOVE, OF = 5, 6
# Edges that one task of `sequence` streams at most, up to one node's.
BLOCK_ROWS = 4_000_000
# Ends of paths that `hops` puts into one list, counted with repeats.
MOST_LISTED = 10_000_000


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def degree_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).groupBy("deg").agg(F.count(F.lit(1)).alias("n"))


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes reached from roots (node)."""
    edges = cut(edges.select("src", "dst").distinct())
    return seminaive(roots.select("node"), lambda new: new.join(edges, new.node == edges.src).select(F.col("dst").alias("node")))


def bfs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, dist: hops from the nearest root."""
    edges = cut(edges.select("src", "dst").distinct())
    seed = roots.select("node", F.lit(0).cast("long").alias("dist"))
    return seminaive(seed, lambda new: new.join(edges, new.node == edges.src).select(F.col("dst").alias("node"), (F.col("dist") + 1).alias("dist")), key=["node"])


def shortest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, dist: the smallest sum of `weight` (non-negative) from a root; (min, +) in place of (+, *)."""
    edges = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    seed = roots.select("node", F.lit(0).cast("long").alias("dist"))

    def body(state: DataFrame) -> DataFrame:
        moved = state.join(edges, state.node == edges.src).select(F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        return moved.unionByName(seed).groupBy("node").agg(F.min("dist").alias("dist"))

    return iterate(seed, body)


def _few(parts: list[DataFrame]) -> list[DataFrame]:
    """The same rows in few tables, however many rounds there are."""
    return parts if len(parts) <= 8 else [cut(fold(DataFrame.unionByName, parts))]


def bidijkstra(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """src, dst, hops for the goals (src, dst) that are connected.

    Both ends search until they meet; each round moves the end whose frontier is smaller, by whole levels,
    so a goal's frontiers first meet when their levels add up to its distance. For each goal the smaller of its two
    frontiers is looked up in the other; a goal one of whose frontiers is empty can't be reached any more.
    """
    edges = cut(edges.select("src", "dst").distinct())
    ends, steps = ("src", "dst"), (edges, reverse(edges))
    waiting = cut(goals.select("src", "dst").distinct())
    fronts = [cut(waiting.select(F.col(end).alias("root"), F.col(end).alias("node")).distinct()) for end in ends]
    seen, levels, found = [[f] for f in fronts], [0, 0], []
    while True:
        for end, front in zip(ends, fronts):
            waiting = waiting.join(front.groupBy(F.col("root").alias(end)).agg(F.count(F.lit(1)).alias(f"n_{end}")), end)
        waiting = cut(waiting)
        f, b = fronts[0].withColumnRenamed("root", "src"), fronts[1].withColumnRenamed("root", "dst")
        forth = waiting.where("n_src <= n_dst").join(f, "src").join(b, ["dst", "node"], "left_semi")
        back = waiting.where("n_src > n_dst").join(b, "dst").join(f, ["src", "node"], "left_semi")
        met = cut(forth.unionByName(back).select("src", "dst").distinct().withColumn("hops", F.lit(sum(levels)).cast("long")))
        found = _few([*found, met])
        waiting = cut(waiting.join(met, ["src", "dst"], "left_anti"))
        sizes = [waiting.select(end, f"n_{end}").distinct().agg(F.sum(f"n_{end}")).first()[0] for end in ends]
        if sizes[0] is None:
            return fold(DataFrame.unionByName, found)
        i = sizes.index(min(sizes))
        live = fronts[i].join(waiting.select(F.col(ends[i]).alias("root")).distinct(), "root", "left_semi")
        moved = live.join(steps[i], live.node == steps[i].src).select("root", F.col("dst").alias("node")).distinct()
        fronts[i] = cut(moved.join(fold(DataFrame.unionByName, seen[i]), ["root", "node"], "left_anti"))
        seen[i] = _few([*seen[i], fronts[i]])
        levels[i] += 1
        waiting = waiting.select("src", "dst")


def propagate(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: the smallest label that reaches each node; labels: node, label.

    Changes only travel: a round joins the nodes whose label has just shrunk.
    """
    edges = cut(edges.select("src", "dst").distinct())
    state = cut(labels.groupBy("node").agg(F.min("label").alias("label")))
    new = state
    while True:
        moved = new.join(edges, new.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        old = state.select("node", F.col("label").alias("old"))
        new = cut(moved.join(old, "node", "left").where("old is null or label < old").select("node", "label"))
        if new.isEmpty():
            return state
        state = cut(state.unionByName(new).groupBy("node").agg(F.min("label").alias("label")))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, label (the smallest node of its undirected component) for links (src, dst).

    Alternating large-star and small-star steps: links move towards smaller
    nodes until every node hangs directly on its component's smallest, in
    about as many rounds as the logarithm of the longest path.
    """
    stars = links.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    loops = cut(stars.where("a = b").select(F.col("a").alias("node")))
    stars = cut(stars.where("a <> b"))
    state = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        # every a now has smaller neighbours b only
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = cut(small.where("a <> b").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            out = stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
            alone = loops.join(out, "node", "left_anti").select("node", F.col("node").alias("label"))
            return cut(out.unionByName(alone))
        state = now
    raise RuntimeError("components did not settle")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges at nodes that no edge enters or none leaves, over and over."""
    size = edges.count()
    while True:
        ends, starts = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if now in (0, size):
            return edges
        size = now


def strongly_connected(edges: DataFrame) -> DataFrame:
    """The edges whose ends lie in one strongly connected component.

    Each round trims, lets smallest labels travel along the edges, and searches backwards from every node that
    kept its own label among the nodes of that label: what it finds is its component. All labels
    work at once; edges of found components are settled, those between different labels go.
    """
    edges = cut(edges.select("src", "dst").distinct())
    done = [edges.where("src = dst")]
    live = _trimmed(edges.where("src <> dst"))
    while not live.isEmpty():
        nodes = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
        labels = propagate(live, nodes.select("node", F.col("node").alias("label")))
        left, right = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        same = cut(live.join(left, "src").join(right, "dst").where("a = b").select("src", "dst"))
        found = reach(reverse(same), labels.where("node = label").select("node"))
        starts, ends = found.select(F.col("node").alias("src")), found.select(F.col("node").alias("dst"))
        done.append(cut(same.join(starts, "src", "left_semi").join(ends, "dst", "left_semi").select("src", "dst")))
        live = _trimmed(same.join(starts, "src", "left_anti").join(ends, "dst", "left_anti").select("src", "dst"))
    return fold(DataFrame.unionByName, done)


def kcore(edges: DataFrame, k: int) -> DataFrame:
    """The edges of the largest part in which every node has at least k distinct neighbours (undirected)."""
    edges = cut(symmetric(edges).where("src <> dst"))
    size = edges.count()
    while True:
        keep = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        left, right = keep.select("src"), keep.select(F.col("src").alias("dst"))
        edges = cut(edges.join(left, "src", "left_semi").join(right, "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if now == size:
            return edges.where("src < dst")
        size = now


def pagerank(edges: DataFrame, rounds: int, surfers: int = SURFERS, fresh: int = FRESH) -> DataFrame:
    """node, rank in whole surfers: each round five sixths of a node's surfers spread evenly over its edges.

    A node starts with `surfers` and gets `fresh` new ones a round; fractions are cut off.
    """
    edges = cut(edges.select("src", "dst"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    nodes = cut(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    spread = cut(edges.join(degree, "src"))

    def body(state: DataFrame) -> DataFrame:
        moved = spread.join(state, spread.src == state.node).select(F.col("dst").alias("node"), F.expr(f"{MOVE} * rank div ({OF} * deg)").alias("rank"))
        return moved.unionByName(nodes.withColumn("rank", F.lit(fresh).cast("long"))).groupBy("node").agg(F.sum("rank").alias("rank"))

    return iterate(nodes.withColumn("rank", F.lit(surfers).cast("long")), body, rounds)


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c with edges a->b, b->c and a->c, by two binary joins."""
    e = edges.select("src", "dst").distinct()
    ab, bc, ac = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("a", "c")
    return ab.join(bc, "b").join(ac, ["a", "c"], "left_semi").select("a", "b", "c")


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs with a path between them."""
    edges = cut(edges.select("src", "dst").distinct())
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return seminaive(edges, lambda new: new.join(step, new.dst == step.mid).select("src", F.col("end").alias("dst")))


def same_generation(edges: DataFrame) -> DataFrame:
    """a, b: different nodes at equal distance below a common ancestor."""
    edges = cut(edges.select("src", "dst").distinct())
    up, down = edges.toDF("p", "a"), edges.toDF("p", "b")
    seed = up.join(down, "p").where("a <> b").select("a", "b")

    def step(new: DataFrame) -> DataFrame:
        left = new.join(edges.toDF("a", "x"), "a").select("b", "x")
        return left.join(edges.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))

    return seminaive(seed, step)


def hops(edges: DataFrame, roots: DataFrame, n: int, most: int = MOST_LISTED) -> DataFrame:
    """root, node: the distinct ends of paths of exactly n edges.

    Nodes take over the lists of ends of their successors, so what is exchanged are lists and not a row for each
    pair; only nodes that the roots reach in so many steps have lists. Nodes that would get more than `most` ends,
    counted with repeats, get them as rows.
    """
    e = cut(edges.select("src", "dst").distinct())
    starts = cut(roots.select("node").distinct())
    if n == 0:
        return starts.select(F.col("node").alias("root"), "node")
    steps = []
    for _ in range(n):
        steps.append(cut(e.join(starts.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")))
        starts = steps[-1].select(F.col("dst").alias("node")).distinct()
    out = steps[-1]
    for step in reversed(steps[:-1]):
        lists = cut(out.groupBy(F.col("src").alias("mid")).agg(F.collect_list("dst").alias("ends")))
        sizes = lists.select(F.col("mid").alias("dst"), F.size("ends").cast("long").alias("n"))
        large = cut(step.join(sizes, "dst").groupBy("src").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("src"))
        told = step.join(lists, step.dst == lists.mid).select("src", "ends")
        listed = told.join(large, "src", "left_anti").groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"))
        out = listed.select("src", F.explode("ends").alias("dst"))
        if not large.isEmpty():
            out = out.unionByName(told.join(large, "src", "left_semi").select("src", F.explode("ends").alias("dst")).distinct())
    return out.toDF("root", "node")


def attend(organisers: DataFrame, friends: DataFrame, least: int = 3) -> DataFrame:
    """Who attends a party: the organisers, and whoever has at least `least` attending friends (src -> dst: dst hears)."""
    friends = cut(friends.select("src", "dst").distinct())
    organisers = cut(organisers.select("node").distinct())

    def body(state: DataFrame) -> DataFrame:
        heard = state.join(friends, state.node == friends.src).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
        return organisers.unionByName(heard.where(F.col("n") >= least).select(F.col("dst").alias("node"))).distinct()

    return iterate(organisers, body)


def stable_matching(proposals: DataFrame) -> DataFrame:
    """left, right of the stable matching that is best for all lefts; proposals: left, lpref, right, rpref (smaller is better, both sides strict).

    All lefts propose to their best right, and all rights to their best left. Whoever has a proposal gives up all pairs
    that are worse for them than the best one; none of these is in any stable matching. Pairs that choose each other
    are settled and leave, so each round works on what is left of the table. When nothing changes any more, the lefts'
    best are the rest of the matching.
    """
    forth, back = F.struct("lpref", "right"), F.struct("rpref", "left")
    left, right = Window.partitionBy("left"), Window.partitionBy("right")
    live = cut(proposals.select("left", "lpref", "right", "rpref").withColumn("wish", forth == F.min(forth).over(left)))
    size, done = live.count(), []
    while size:
        asked = live.withColumn("like", back == F.min(back).over(right)).withColumn("bound", F.min(F.when(F.col("wish"), back)).over(right))
        asked = asked.where(F.col("bound").isNull() | (back <= F.col("bound"))).drop("bound")
        kept = asked.withColumn("bound", F.min(F.when(F.col("like"), forth)).over(left)).withColumn("best", F.min(forth).over(left))
        kept = kept.where(F.col("bound").isNull() | (forth <= F.col("bound")))
        kept = cut(kept.select("left", "lpref", "right", "rpref", (forth == F.col("best")).alias("wish"), F.expr("wish AND like").alias("both")))
        now, pairs = kept.agg(F.count_if(~F.col("both")), F.count_if("both")).first()
        if pairs:
            done = _few([*done, kept.where("both").select("left", "right")])
        live = kept.where(~F.col("both")).drop("both")
        if (now, pairs) == (size, 0):
            done.append(live.where("wish").select("left", "right"))
            break
        size = now
    return fold(DataFrame.unionByName, done) if done else live.select("left", "right")


def sequence(edges: DataFrame, logic: Callable[[int, dict], int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node, value: logic(node, values of smaller neighbours) for all nodes in order.

    Each node waits for its smaller neighbours, and such orders have no short parallel form (greedy colouring is
    P-complete). So nodes are taken in blocks of consecutive ones with about `block_rows` edges to smaller
    neighbours: values from earlier blocks are joined to a block's edges, and one task streams these in order and
    keeps only the block's own values. Rounds are as many as blocks, however long the ascending paths are.
    """
    both = symmetric(edges).where("src <> dst")
    # a node without smaller neighbours has one row, with itself
    starts = both.groupBy("src").agg(F.min("dst").alias("least")).where("least > src").select(F.col("src").alias("node"), F.col("src").alias("other"))
    rows = cut(both.where("dst < src").select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(starts))
    blocks = -(-rows.count() // block_rows)
    bounds = sorted(set(rows.approxQuantile("node", [i / blocks for i in range(1, blocks)], 0.1 / blocks))) if blocks > 1 else []

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        node, others = None, {}
        for batch in batches:
            found = []
            for n, o, value, earlier in zip(*[batch[c].tolist() for c in ("node", "other", "value", "earlier")]):
                if n != node:
                    if node is not None:
                        known[node] = logic(node, others)
                        found.append(node)
                    node, others = n, {}
                if o != n:
                    others[o] = value if earlier else known[o]
            yield pd.DataFrame({"node": found, "value": [known[x] for x in found]}, dtype="int64")
        if node is not None:
            yield pd.DataFrame({"node": [node], "value": [logic(node, others)]}, dtype="int64")

    parts: list[DataFrame] = []
    for low, high in zip([None, *map(int, bounds)], [*map(int, bounds), None]):
        mine = rows if low is None else rows.where(F.col("node") > low)
        mine = mine if high is None else mine.where(F.col("node") <= high)
        inner = mine if low is None else mine.where(F.col("other") > low)
        block = inner.select("node", "other", F.lit(0).cast("long").alias("value"), F.lit(False).alias("earlier"))
        if parts:
            known = fold(DataFrame.unionByName, parts).withColumnRenamed("node", "other")
            block = block.unionByName(mine.where(F.col("other") <= low).join(known, "other").select("node", "other", "value", F.lit(True).alias("earlier")))
        parts = _few([*parts, cut(block.repartition(1).sortWithinPartitions("node").mapInPandas(settle, "node long, value long"))])
    return fold(DataFrame.unionByName, parts)


def least_free(node: int, others: dict) -> int:
    """Greedy colouring: the smallest number no settled neighbour has."""
    used = set(others.values())
    value = 0
    while value in used:
        value += 1
    return value


def item_similarity(pairs: DataFrame, least_percent: int = 5) -> DataFrame:
    """a, b, shared, total for items whose users' Jaccard similarity exceeds a bound; pairs: user, item.

    Rows and pairs of items are dealt over as many tasks as their numbers ask for; that of the pairs is known from the
    users' sizes.
    """
    tasks = tasks_for(pairs.sparkSession, pairs.count())
    own = cut(pairs.select("user", "item").repartition(tasks, "user").distinct())
    size = F.count(F.lit(1))
    both = own.groupBy("user").agg((size * (size - 1) / 2).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    users = own.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    met = own.toDF("user", "a").repartition(tasks, "user").join(own.toDF("user", "b").repartition(tasks, "user"), "user").where("a < b").select("a", "b")
    met = met.repartition(tasks_for(own.sparkSession, both), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = met.join(users.toDF("a", "na"), "a").join(users.toDF("b", "nb"), "b").withColumn("total", F.expr("na + nb - shared"))
    return sized.where(F.col("shared") * 100 > F.col("total") * least_percent).select("a", "b", "shared", "total")


def identifiers(records: DataFrame) -> DataFrame:
    """records (distinct) with a collision-free 64-bit `id`: a hash of (round, record), losers try the next round."""
    columns = records.columns
    waiting = cut(records.distinct().withColumn("__round", F.lit(0).cast("long")))
    done = None
    while True:
        tried = waiting.withColumn("id", F.xxhash64("__round", *columns))
        if done is not None:
            tried = tried.unionByName(done.withColumn("__round", F.lit(-1).cast("long")))
        first = cut(tried.groupBy("id").agg(F.min(F.struct("__round", *columns)).alias("w"), F.count(F.lit(1)).alias("n")))
        winners = first.select("w.*", "id")
        done = cut(winners.select(*columns, "id"))
        if first.where("n > 1").isEmpty():
            return done
        waiting = cut(waiting.join(done.select(*columns), columns, "left_anti").withColumn("__round", F.col("__round") + 1))
