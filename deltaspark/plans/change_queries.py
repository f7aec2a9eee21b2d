"""Queries over changing collections: upserts, the change protocol, incremental maintenance, recipes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..collection import T, W, Collection
from ..operators import upsert
from ..sources import cdc, inputs
from ..storage import shared_folder
from ..streaming import maintain
from .relational import _DAY, _SQL_DAY, history, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH s AS (SELECT user_id, {_SQL_DAY} AS t, max(event_type) FILTER (event_type <> 'error') AS v FROM events GROUP BY 1, 2),
 c AS (SELECT user_id, t, v, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS o FROM s), d AS (SELECT * FROM c WHERE v IS DISTINCT FROM o)
 SELECT user_id, v, t, 1::BIGINT AS w FROM d WHERE v IS NOT NULL UNION ALL SELECT user_id, o, t, -1::BIGINT FROM d WHERE o IS NOT NULL""")
def upserts(spark, d):
    """The last event type of each user and day, deleted by errors, as changes."""
    events = table(spark, d, "events").select("user_id", F.expr(_DAY).alias(T), F.when(F.col("event_type") != "error", F.col("event_type")).alias("v"))
    return history(upsert.from_upserts(events, ["user_id"], "v"))


@query(f"SELECT user_id, {_SQL_DAY} AS t, count(*)::BIGINT AS w FROM events WHERE {_SQL_DAY} < 12 GROUP BY 1, 2")
def change_protocol(spark, d):
    """What is released of doubled, reordered updates whose last interval is short of some."""
    events = table(spark, d, "events").select("user_id", F.expr(_DAY).alias(T), F.lit(1).cast("long").alias(W))
    folder = _folder(spark, "cdc")
    whole = Collection(events)
    for lower, upper in ((6, 12), (0, 6), (6, 12)):
        cdc.write(whole, folder, lower, upper)
    cdc.write(whole.filter(F.col(T) < 14), folder, 12, 14)
    updates, progress = spark.read.parquet(f"{folder}/updates"), spark.read.parquet(f"{folder}/progress")
    return history(cdc.released(updates.where(f"NOT ({T} = 12 AND user_id % 2 = 0)"), progress))


@query(f"SELECT user_id % 10 AS k, {_SQL_DAY} // 8 AS t, count(*)::BIGINT AS n FROM (SELECT user_id, ts FROM events) GROUP BY 1, 2 HAVING {'count(*)'} > 0")
def events_by_period(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("k"), F.expr(f"({_DAY}) div 8").alias("t"))
    return Collection.of(rows).count("n").df.drop(W)


@query(f"""WITH e AS (SELECT user_id % 10 AS k, ({_SQL_DAY}) // 8 AS t, count(*) AS w FROM events GROUP BY 1, 2),
 r AS (SELECT k, t, w, sum(w) OVER (PARTITION BY k ORDER BY t)::BIGINT AS now FROM e)
 SELECT k, now AS n, t, 1::BIGINT AS w FROM r UNION ALL SELECT k, (now - w)::BIGINT, t, -1::BIGINT FROM r WHERE now <> w""")
def maintained_count(spark, d):
    """Counts kept up to date epoch by epoch; the changes of all epochs."""
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("k"), F.expr(f"({_DAY}) div 8").alias(T), F.lit(1).cast("long").alias(W))
    counts = maintain.Reduce(spark, _folder(spark, "count"), "k long", ["k"], lambda c: c.count("n"))
    out = None
    for epoch, change in maintain.by_epoch(Collection(rows)):
        step = counts.step(epoch, change).df.withColumn(T, F.lit(epoch).cast("long"))
        out = step if out is None else out.unionByName(step)
    return history(Collection(out))


@query(f"""WITH e AS (SELECT user_id AS k, event_type, ({_SQL_DAY}) // 10 AS t FROM events),
 p AS (SELECT k, t FROM e WHERE event_type = 'purchase'), c AS (SELECT k, t FROM e WHERE event_type = 'click')
 SELECT p.k, greatest(p.t, c.t) AS t, count(*)::BIGINT AS w FROM p JOIN c ON p.k = c.k GROUP BY 1, 2""")
def maintained_join(spark, d):
    """Pairs of purchases and clicks of a user, kept up to date epoch by epoch."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_type", F.expr(f"({_DAY}) div 10").alias(T), F.lit(1).cast("long").alias(W))
    return _joined(spark, rows)


def _joined(spark, rows):
    bought, clicked = (Collection(rows.where(F.col("event_type") == x).drop("event_type")) for x in ("purchase", "click"))
    join = maintain.Join(spark, _folder(spark, "join"), "k long", "k long", ["k"])
    out = None
    for epoch in sorted({*bought.epochs(), *clicked.epochs()}):
        at = lambda c: Collection(c.df.where(F.col(T) == epoch).drop(T))
        step = join.step(epoch, at(bought), at(clicked)).df.withColumn(T, F.lit(epoch).cast("long"))
        out = step if out is None else out.unionByName(step)
    return history(Collection(out))


@query("SELECT range AS k0 FROM range(500)")
def recipe_iota(spark, d):
    return inputs.recipe(spark, "iota:500")


@query(None)
def recipe_random(spark, d):
    return inputs.recipe(spark, "random:nodes=50,edges=55")


@query(None)
def sliding_window_graph(spark, d):
    return history(inputs.sliding_window(spark, 100, 200, 50))
