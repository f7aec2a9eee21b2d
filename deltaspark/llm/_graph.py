"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

MOST_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for links with columns a and b (longs).

    Alternating large-star and small-star steps: links move towards smaller
    nodes until every node hangs directly on its component's smallest. Each
    round is aggregations and joins of the link table, cut off by a table.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = _store.cut(links)
    state = None
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = _store.cut(large)
        # every a now only has smaller neighbours b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = _store.cut(small.where("a <> b").distinct())
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("y")).first()
        if now == state:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return _store.cut(links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots))
        state = now
    raise RuntimeError("components did not settle")
