"""Queries that apply one operator each to the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import T, W, Collection

#: name -> (query, SQL)
QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coll(spark: SparkSession, sf_dir: str, name: str, *columns, unit: bool = False) -> Collection:
    return Collection.of(table(spark, sf_dir, name).select(*columns), unit)


def weighted(c: Collection) -> DataFrame:
    """A consolidated collection with its weight as column w."""
    return c.consolidate().df.withColumnRenamed(W, "w")


def history(c: Collection) -> DataFrame:
    return c.consolidate().df.withColumnsRenamed({W: "w", T: "t"})


_DAY = "CAST(datediff(to_date(ts), DATE '2024-01-01') AS BIGINT)"
_SQL_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT)"


@query("SELECT deg, count(*) AS n FROM (SELECT l_partkey, count(*) AS deg FROM lineitem GROUP BY 1) GROUP BY 1")
def degree_distribution(spark, d):
    degrees = coll(spark, d, "lineitem", "l_partkey").count("deg")
    return degrees.map("deg").count("n").df.select("deg", "n")


@query("SELECT o_orderkey, o_custkey * 2 + 1 AS c, 1::BIGINT AS w FROM orders")
def map_(spark, d):
    return weighted(coll(spark, d, "orders", "o_orderkey", "o_custkey").map("o_orderkey", (F.col("o_custkey") * 2 + 1).alias("c")))


@query("SELECT o_orderkey, o_orderstatus, 1::BIGINT AS w FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def filter_(spark, d):
    return weighted(coll(spark, d, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus = 'F' AND o_orderkey % 3 = 0"))


@query("SELECT doc_id, word, count(*)::BIGINT AS w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1, 2")
def flat_map(spark, d):
    return weighted(coll(spark, d, "documents", "doc_id", "text").flat_map(F.split("text", " ", -1), "word", "doc_id"))


@query("SELECT l_returnflag, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem GROUP BY 1")
def explode_sum(spark, d):
    lines = coll(spark, d, "lineitem", "l_returnflag", "l_quantity")
    return lines.explode(F.col("l_quantity").cast("long"), "l_returnflag").count("qty").df.drop(W)


@query(f"""SELECT user_id, t, sum(w)::BIGINT AS w FROM (
 SELECT user_id, {_SQL_DAY} AS t, 1 AS w FROM events UNION ALL SELECT user_id, {_SQL_DAY} + 7, -1 FROM events) GROUP BY 1, 2 HAVING sum(w) <> 0""")
def join_function(spark, d):
    events = table(spark, d, "events").select("user_id", F.expr(_DAY).alias("day"))
    valid = Collection.of(events)
    starts = valid.join_function(["user_id"], "day", F.lit(1))
    return history(starts.concat(valid.join_function(["user_id"], F.col("day") + 7, F.lit(-1))))


@query("SELECT k, sum(w)::BIGINT AS w FROM (SELECT o_custkey % 50 AS k, 1 AS w FROM orders UNION ALL SELECT c_custkey % 50, -1 FROM customer) GROUP BY 1 HAVING sum(w) <> 0")
def negate_concat(spark, d):
    orders = coll(spark, d, "orders", (F.col("o_custkey") % 50).alias("k"))
    return weighted(orders.subtract(coll(spark, d, "customer", (F.col("c_custkey") % 50).alias("k"))))


@query(f"SELECT user_id, (({_SQL_DAY}) // 7 + 1) * 7 AS t, count(*)::BIGINT AS w FROM events GROUP BY 1, 2")
def delay(spark, d):
    events = Collection(table(spark, d, "events").select("user_id", F.expr(_DAY).alias(T), F.lit(1).cast("long").alias(W)))
    return history(events.delay(F.expr(f"({T} div 7 + 1) * 7")))


@query("SELECT l_partkey, l_suppkey, count(*)::BIGINT AS w FROM lineitem GROUP BY 1, 2")
def consolidate(spark, d):
    return weighted(coll(spark, d, "lineitem", "l_partkey", "l_suppkey"))


@query("SELECT o_orderkey, o_custkey, c_nationkey, 1::BIGINT AS w FROM orders JOIN customer ON o_custkey = c_custkey")
def join(spark, d):
    orders = coll(spark, d, "orders", "o_orderkey", F.col("o_custkey").alias("k"))
    customers = coll(spark, d, "customer", F.col("c_custkey").alias("k"), "c_nationkey")
    return weighted(orders.join(customers, ["k"]).map("o_orderkey", F.col("k").alias("o_custkey"), "c_nationkey"))


@query("SELECT o_orderkey, l_partkey, (2 * count(*))::BIGINT AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40 GROUP BY 1, 2")
def join_core(spark, d):
    orders = coll(spark, d, "orders", F.col("o_orderkey").alias("k"))
    lines = coll(spark, d, "lineitem", F.col("l_orderkey").alias("k"), "l_partkey", "l_quantity")
    return weighted(orders.concat(orders).join(lines, ["k"]).filter("l_quantity > 40").map(F.col("k").alias("o_orderkey"), "l_partkey"))


@query("SELECT c_custkey, c_nationkey, n AS w FROM customer JOIN (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def semijoin_weighted(spark, d):
    customers = coll(spark, d, "customer", "c_custkey", "c_nationkey")
    return weighted(customers.semijoin(coll(spark, d, "orders", F.col("o_custkey").alias("c_custkey")), ["c_custkey"]))


@query("SELECT c_custkey, c_nationkey, 1::BIGINT AS w FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semijoin_distinct(spark, d):
    customers = coll(spark, d, "customer", "c_custkey", "c_nationkey")
    return weighted(customers.semijoin(coll(spark, d, "orders", F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"]))


@query("SELECT c_custkey, c_nationkey, 1::BIGINT AS w FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def antijoin(spark, d):
    customers = coll(spark, d, "customer", "c_custkey", "c_nationkey")
    return weighted(customers.antijoin(coll(spark, d, "orders", F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"]))


@query("SELECT c_custkey, c_nationkey, (1 - coalesce(n, 0))::BIGINT AS w FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE 1 - coalesce(n, 0) <> 0")
def antijoin_weighted(spark, d):
    customers = coll(spark, d, "customer", "c_custkey", "c_nationkey")
    return weighted(customers.antijoin(coll(spark, d, "orders", F.col("o_custkey").alias("c_custkey")), ["c_custkey"]))


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def outer_count(spark, d):
    """The outer join idiom: add each key once, count, take one off."""
    keys = coll(spark, d, "orders", F.col("o_custkey").alias("c_custkey"))
    counts = keys.concat(coll(spark, d, "customer", "c_custkey")).count("n")
    return counts.df.select("c_custkey", (F.col("n") - 1).alias("orders"))


@query(f"""WITH r AS (SELECT DISTINCT user_id, {_SQL_DAY} AS t FROM events WHERE event_type = 'purchase'),
 h AS (SELECT user_id, event_type, {_SQL_DAY} AS t2 FROM events)
 SELECT r.user_id, event_type, t, count(*)::BIGINT AS w FROM r JOIN h ON r.user_id = h.user_id AND t2 <= t GROUP BY 1, 2, 3""")
def lookup_as_of(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.expr(_DAY).alias(T), F.lit(1).cast("long").alias(W))
    asked = events.where("event_type = 'purchase'").select("user_id", T, W).distinct()
    return history(Collection(events).lookup(Collection(asked), ["user_id"]))


@query("SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def count(spark, d):
    return coll(spark, d, "lineitem", "l_suppkey").count("n").df.drop(W)


@query(f"""WITH c AS (SELECT user_id, {_SQL_DAY} AS t, count(*) AS dlt FROM events GROUP BY 1, 2),
 r AS (SELECT user_id, t, sum(dlt) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS now, dlt FROM c)
 SELECT user_id, now AS n, t, 1::BIGINT AS w FROM r UNION ALL SELECT user_id, (now - dlt)::BIGINT, t, -1::BIGINT FROM r WHERE now - dlt <> 0""")
def count_total(spark, d):
    """All changes of the counts, at every time."""
    events = table(spark, d, "events").select("user_id", F.expr(_DAY).alias(T), F.lit(1).cast("long").alias(W))
    return history(Collection(events).count("n"))


@query(f"""WITH u AS (SELECT user_id, {_SQL_DAY} AS t, 1 AS w FROM events UNION ALL SELECT user_id, {_SQL_DAY} + 3, -1 FROM events),
 c AS (SELECT user_id, t, sum(w) AS dlt FROM u GROUP BY 1, 2 HAVING sum(w) <> 0),
 r AS (SELECT user_id, t, sum(dlt) OVER (PARTITION BY user_id ORDER BY t) AS now, dlt FROM c)
 SELECT user_id, t, ((now <> 0)::INT - (now - dlt <> 0)::INT)::BIGINT AS w FROM r WHERE (now <> 0) <> (now - dlt <> 0)""")
def distinct_total(spark, d):
    """Active users over a sliding window of three days, as changes."""
    valid = Collection.of(table(spark, d, "events").select("user_id", F.expr(_DAY).alias("day")))
    window = valid.join_function(["user_id"], "day", F.lit(1)).concat(valid.join_function(["user_id"], F.col("day") + 3, F.lit(-1)))
    return history(window.distinct())


@query("SELECT DISTINCT l_partkey, l_suppkey, 1::BIGINT AS w FROM lineitem")
def distinct(spark, d):
    return weighted(coll(spark, d, "lineitem", "l_partkey", "l_suppkey").distinct())


@query("SELECT l_partkey, (count(*) - 2)::BIGINT AS w FROM lineitem GROUP BY 1 HAVING count(*) > 2")
def threshold(spark, d):
    return weighted(coll(spark, d, "lineitem", "l_partkey").threshold(lambda w: F.greatest(w - 2, F.lit(0))))


@query("SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1")
def reduce_min(spark, d):
    return coll(spark, d, "orders", "o_custkey", "o_orderkey").min(["o_custkey"], "o_orderkey", "first").df.drop(W)


@query("SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1")
def reduce_max(spark, d):
    return coll(spark, d, "orders", "o_custkey", "o_orderkey").max(["o_custkey"], "o_orderkey", "last").df.drop(W)


@query("""WITH c AS (SELECT l_suppkey, l_partkey, count(*)::BIGINT AS w FROM lineitem GROUP BY 1, 2)
 SELECT l_suppkey, min(l_partkey) AS v, count(*)::BIGINT AS w FROM c GROUP BY 1""")
def reduce_general(spark, d):
    """A reduction given as a function: the smallest value, as often as there are values."""
    lines = coll(spark, d, "lineitem", "l_suppkey", "l_partkey").consolidate()
    return weighted(lines.reduce(["l_suppkey"], ["l_partkey"], lambda key, values: [(values[0][0], len(values))], "v long"))


@query("""SELECT p_brand, p_partkey, p_size, 1::BIGINT AS w FROM part p WHERE p_size = (SELECT min(q.p_size) FROM part q WHERE q.p_brand = p.p_brand)""")
def min_with_ties(spark, d):
    return weighted(coll(spark, d, "part", "p_brand", "p_partkey", "p_size").first_with_ties(["p_brand"], "p_size"))


@query("WITH c AS (SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n FROM c WHERE n = (SELECT max(n) FROM c)")
def argmax(spark, d):
    return coll(spark, d, "lineitem", "l_suppkey").count("n").first_with_ties([], "n", largest=True).df.drop(W)


@query("SELECT o_custkey, list_sort(list(o_orderkey % 10))::VARCHAR AS vals FROM orders GROUP BY 1")
def collect(spark, d):
    lists = coll(spark, d, "orders", "o_custkey", (F.col("o_orderkey") % 10).alias("v")).collect(["o_custkey"], "v", "vals")
    return lists.df.select("o_custkey", F.concat(F.lit("["), F.array_join("vals", ", "), F.lit("]")).alias("vals"))


@query("SELECT o_custkey, o_orderkey, (coalesce(sum(o_orderkey % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM orders")
def prefix_sum(spark, d):
    orders = coll(spark, d, "orders", "o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).alias("v"))
    return orders.prefix_sum("o_orderkey", "v", ["o_custkey"], "before").df.select("o_custkey", "o_orderkey", "before")


@query("SELECT o_orderkey, max(o_orderkey * 7919 % 10007) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders")
def prefix_combine(spark, d):
    """The greatest value of all earlier orders, without keys."""
    orders = coll(spark, d, "orders", "o_orderkey", (F.col("o_orderkey") * 7919 % 10007).alias("v"))
    return orders.prefix_combine("o_orderkey", "v", F.greatest).df.select("o_orderkey", "before")


@query("SELECT l_returnflag, sum(l_quantity::BIGINT)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, count(*)::BIGINT AS n, (sum(l_quantity::BIGINT) // count(*))::BIGINT AS avg_qty FROM lineitem GROUP BY 1")
def multi_aggregate(spark, d):
    lines = coll(spark, d, "lineitem", "l_returnflag", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    return lines.sums(["l_returnflag"], qty="q", cents="c", n=F.lit(1)).df.drop(W).withColumn("avg_qty", F.expr("qty div n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def conditional_count(spark, d):
    orders = coll(spark, d, "orders", "o_orderpriority", "o_orderstatus")
    return orders.sums(["o_orderpriority"], done=F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), n=F.lit(1)).df.drop(W)


@query("SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem GROUP BY 1")
def count_distinct(spark, d):
    return coll(spark, d, "lineitem", "l_partkey", "l_suppkey").distinct().map("l_partkey").count("n").df.drop(W)


@query("WITH c AS (SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1), s AS (SELECT sum(n) AS total, count(*) AS k FROM c) SELECT l_suppkey, n FROM c, s WHERE n * k > total")
def having_global(spark, d):
    """Keys above the mean of all."""
    counts = coll(spark, d, "lineitem", "l_suppkey").count("n")
    total = counts.sums([], total="n", k=F.lit(1))
    return counts.cross(total).filter("n * k > total").df.select("l_suppkey", "n")


@query("SELECT n_regionkey AS k, 1::BIGINT AS w FROM nation UNION SELECT r_regionkey, 1 FROM region")
def union_distinct(spark, d):
    return weighted(coll(spark, d, "nation", F.col("n_regionkey").alias("k")).union(coll(spark, d, "region", F.col("r_regionkey").alias("k"))))


@query("SELECT k, 1::BIGINT AS w FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def intersect(spark, d):
    lines = coll(spark, d, "lineitem", F.col("l_partkey").alias("k"), "l_quantity")
    return weighted(lines.filter("l_quantity > 45").map("k").intersect(lines.filter("l_quantity < 3").map("k")))


@query(f"SELECT user_id, event_type, count(*)::BIGINT AS w FROM events WHERE {_SQL_DAY} <= 10 GROUP BY 1, 2")
def snapshot(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.expr(_DAY).alias(T), F.lit(1).cast("long").alias(W))
    return weighted(Collection(events).snapshot(10))


@query(f"SELECT user_id, greatest({_SQL_DAY}, 10) AS t, count(*)::BIGINT AS w FROM events WHERE {_SQL_DAY} < 20 GROUP BY 1, 2")
def import_frontier(spark, d):
    events = table(spark, d, "events").select("user_id", F.expr(_DAY).alias(T), F.lit(1).cast("long").alias(W))
    return history(Collection(events).between(10, 20))


@query("""SELECT campaign, count(*)::BIGINT AS n FROM (SELECT user_id % 100 AS campaign FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def ad_campaigns(spark, d):
    """Purchases for each campaign, through a table of links."""
    purchases = coll(spark, d, "events", F.col("user_id").alias("ad"), "event_type").filter("event_type = 'purchase'")
    links = Collection.of(table(spark, d, "events").select(F.col("user_id").alias("ad")).distinct().withColumn("campaign", F.col("ad") % 100), True)
    return purchases.join(links, ["ad"]).map("campaign").count("n").df.drop(W)


@query("SELECT a AS q1, b AS q2, count(*)::BIGINT AS n FROM orders, range(0, 4) x(a), range(0, 3) y(b) WHERE o_orderkey % 5 <= a AND o_custkey % 4 <= b GROUP BY 1, 2")
def bitemporal_count(spark, d):
    """Counts at points of a partially ordered time."""
    updates = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("t1"), (F.col("o_custkey") % 4).alias("t2"))
    grouped = updates.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    points = spark.range(4).select(F.col("id").alias("q1")).crossJoin(spark.range(3).select(F.col("id").alias("q2")))
    return grouped.join(F.broadcast(points), (F.col("t1") <= F.col("q1")) & (F.col("t2") <= F.col("q2"))).groupBy("q1", "q2").agg(F.sum("n").alias("n"))
