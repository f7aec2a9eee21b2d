"""The 22 TPC-H-like queries, on the tables that exist.

They follow the semantics of incremental TPC-H programs rather than the
official text: integer arithmetic (cents, per cent), no ordering or limits.
There is no partsupp table and some columns are missing, so queries that need
them use stand-ins, named in each docstring; constants are shifted to where
the data are. Revenue is in 1/10000 of the currency: cents * (100 - discount %).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..collection import W, Collection
from .relational import table

QUERIES: dict[str, tuple] = {}

_L = """l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS ship, CAST(l_quantity AS BIGINT) AS qty,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem)"""
_O = "o AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders)"
_PS = "ps AS (SELECT l_partkey AS partkey, l_suppkey AS suppkey, min(cents) AS cost, sum(qty)::BIGINT AS avail FROM l GROUP BY 1, 2)"


def query(sql: str | None):
    def add(f):
        QUERIES["tpch_" + f.__name__] = (f, sql)
        return f

    return add


def lines(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("ship"), F.col("l_quantity").cast("long").alias("qty"),
        cents("l_extendedprice").alias("cents"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"),
    )


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))


def partsupp(spark, d):
    return lines(spark, d).groupBy(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).agg(F.min("cents").alias("cost"), F.sum("qty").alias("avail"))


def packed(day):
    """A date as the number yyyymmdd."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def money():
    return F.expr("cents * (100 - disc)")


def totals(df, keys, **measures):
    return Collection.of(df).sums(keys, **measures).df.drop(W)


@query(f"""WITH {_L} SELECT l_returnflag, l_linestatus, sum(qty)::BIGINT AS qty, sum(cents)::BIGINT AS base, sum(cents * (100 - disc))::BIGINT AS revenue,
 sum(cents * (100 - disc) * (100 + tax))::BIGINT AS charge, sum(disc)::BIGINT AS disc, count(*)::BIGINT AS n FROM l WHERE ship <= DATE '1998-09-02' GROUP BY 1, 2""")
def q01(spark, d):
    """Six sums in one pass."""
    rows = lines(spark, d).where("ship <= DATE '1998-09-02'")
    return totals(rows, ["l_returnflag", "l_linestatus"], qty="qty", base="cents", revenue=money(), charge=money() * (100 + F.col("tax")), disc="disc", n=F.lit(1))


@query(f"""WITH {_L}, {_PS}, x AS (SELECT partkey, suppkey, cost, n_name FROM ps JOIN part ON p_partkey = partkey JOIN supplier ON s_suppkey = suppkey JOIN nation ON n_nationkey = s_nationkey
 WHERE n_regionkey = 3 AND p_size = 15) SELECT partkey, suppkey, cost, n_name FROM x WHERE cost = (SELECT min(y.cost) FROM x y WHERE y.partkey = x.partkey)""")
def q02(spark, d):
    """Cheapest suppliers of a region for parts of a size, with ties; partsupp is made from lineitem."""
    nations = table(spark, d, "nation").where("n_regionkey = 3")
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = table(spark, d, "part").where("p_size = 15").select("p_partkey")
    offers = partsupp(spark, d).join(parts, F.col("partkey") == F.col("p_partkey")).join(suppliers, F.col("suppkey") == F.col("s_suppkey"))
    best = Collection.of(offers.select("partkey", "suppkey", "cost", "n_name"), True).first_with_ties(["partkey"], "cost")
    return best.df.drop(W)


@query(f"""WITH {_L}, {_O} SELECT o_orderkey, strftime(day, '%Y%m%d')::INT AS day, sum(cents * (100 - disc))::BIGINT AS revenue FROM customer JOIN o ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey
 WHERE c_mktsegment = 'BUILDING' AND day < DATE '1995-03-15' AND ship > DATE '1995-03-15' GROUP BY 1, 2""")
def q03(spark, d):
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    mine = orders(spark, d).where("day < DATE '1995-03-15'").join(customers, "o_custkey", "left_semi")
    rows = lines(spark, d).where("ship > DATE '1995-03-15'").join(mine, F.col("l_orderkey") == F.col("o_orderkey"))
    return totals(rows.withColumn("day", packed("day")), ["o_orderkey", "day"], revenue=money())


@query(f"""WITH {_L}, {_O} SELECT o_orderpriority, count(*)::BIGINT AS n FROM o WHERE day >= DATE '1996-07-01' AND day < DATE '1996-10-01'
 AND o_orderkey IN (SELECT l_orderkey FROM l WHERE qty > 40) GROUP BY 1""")
def q04(spark, d):
    """Orders with a large line (in place of a late one), by priority."""
    late = Collection.of(lines(spark, d).where("qty > 40").select(F.col("l_orderkey").alias("o_orderkey"))).distinct()
    mine = Collection.of(orders(spark, d).where("day >= DATE '1996-07-01' AND day < DATE '1996-10-01'"))
    return mine.semijoin(late, ["o_orderkey"]).map("o_orderpriority").count("n").df.drop(W)


@query(f"""WITH {_L}, {_O} SELECT s_nationkey AS nation, sum(cents * (100 - disc))::BIGINT AS revenue FROM customer JOIN o ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey
 JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 AND year(day) = 1996 GROUP BY 1""")
def q05(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("nation"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")).join(nations, "nation")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")).join(nations, "nation")
    mine = orders(spark, d).where("year(day) = 1996").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines(spark, d).join(mine, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("l_suppkey", "s_suppkey")
    return totals(rows.join(suppliers, ["s_suppkey", "nation"]), ["nation"], revenue=money())


@query(f"WITH {_L} SELECT sum(cents * disc)::BIGINT AS revenue FROM l WHERE year(ship) = 1996 AND disc BETWEEN 5 AND 7 AND qty < 24")
def q06(spark, d):
    return totals(lines(spark, d).where("year(ship) = 1996 AND disc BETWEEN 5 AND 7 AND qty < 24"), [], revenue=F.expr("cents * disc"))


@query(f"""WITH {_L}, {_O} SELECT s_nationkey AS supp_nation, c_nationkey AS cust_nation, year(ship)::INT AS y, sum(cents * (100 - disc))::BIGINT AS revenue FROM l JOIN o ON l_orderkey = o_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE (s_nationkey = 6 AND c_nationkey = 7 OR s_nationkey = 7 AND c_nationkey = 6) AND year(ship) IN (1995, 1996) GROUP BY 1, 2, 3""")
def q07(spark, d):
    suppliers = table(spark, d, "supplier").where("s_nationkey IN (6, 7)").select("s_suppkey", F.col("s_nationkey").alias("supp_nation"))
    customers = table(spark, d, "customer").where("c_nationkey IN (6, 7)").select("c_custkey", F.col("c_nationkey").alias("cust_nation"))
    mine = orders(spark, d).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines(spark, d).where("year(ship) IN (1995, 1996)").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(mine, F.col("l_orderkey") == F.col("o_orderkey"))
    return totals(rows.where("supp_nation <> cust_nation").withColumn("y", F.year("ship")), ["supp_nation", "cust_nation", "y"], revenue=money())


@query(f"""WITH {_L}, {_O} SELECT year(day)::INT AS y, sum(CASE WHEN s_nationkey = 8 THEN cents * (100 - disc) ELSE 0 END)::BIGINT AS own, sum(cents * (100 - disc))::BIGINT AS total
 FROM l JOIN o ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
 WHERE n_regionkey = 1 AND year(day) IN (1995, 1996) AND p_type = 'ECONOMY' GROUP BY 1""")
def q08(spark, d):
    """A nation's revenue and the total, as a pair of sums."""
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = table(spark, d, "customer").join(nations, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    mine = orders(spark, d).where("year(day) IN (1995, 1996)").join(customers, "o_custkey", "left_semi")
    parts = table(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    rows = lines(spark, d).join(parts, "l_partkey", "left_semi").join(mine, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return totals(rows.withColumn("y", F.year("day")), ["y"], own=F.when(F.col("s_nationkey") == 8, money()).otherwise(0), total=money())


@query(f"""WITH {_L}, {_O}, {_PS} SELECT s_nationkey AS nation, year(day)::INT AS y, sum(cents * (100 - disc) - 10 * cost * qty)::BIGINT AS profit FROM l JOIN part ON p_partkey = l_partkey
 JOIN ps ON partkey = l_partkey AND suppkey = l_suppkey JOIN o ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_brand LIKE '%2%' GROUP BY 1, 2""")
def q09(spark, d):
    """Profit by nation and year; partsupp is made from lineitem, the name filter is on the brand."""
    parts = table(spark, d, "part").where("p_brand LIKE '%2%'").select(F.col("p_partkey").alias("l_partkey"))
    cost = partsupp(spark, d).select(F.col("partkey").alias("l_partkey"), F.col("suppkey").alias("l_suppkey"), "cost")
    rows = lines(spark, d).join(parts, "l_partkey", "left_semi").join(cost, ["l_partkey", "l_suppkey"]).join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), F.col("l_suppkey") == F.col("s_suppkey"))
    return totals(rows.withColumn("y", F.year("day")), ["nation", "y"], profit=money() - F.expr("10 * cost * qty"))


@query(f"""WITH {_L}, {_O} SELECT c_custkey, c_name, c_nationkey, sum(cents * (100 - disc))::BIGINT AS revenue FROM l JOIN o ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
 WHERE l_returnflag = 'R' AND day > DATE '1996-10-01' AND day <= DATE '1997-01-01' GROUP BY 1, 2, 3""")
def q10(spark, d):
    mine = orders(spark, d).where("day > DATE '1996-10-01' AND day <= DATE '1997-01-01'")
    rows = lines(spark, d).where("l_returnflag = 'R'").join(mine, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = totals(rows, ["o_custkey"], revenue=money())
    return sums.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "c_nationkey", "revenue")


@query(f"""WITH {_L}, {_PS}, v AS (SELECT partkey, sum(cost * avail)::BIGINT AS value FROM ps JOIN supplier ON s_suppkey = suppkey WHERE s_nationkey = 7 GROUP BY 1)
 SELECT partkey, value FROM v WHERE value > (SELECT sum(value) // 1000 FROM v)""")
def q11(spark, d):
    """Parts above a share of the total value; partsupp is made from lineitem."""
    suppliers = table(spark, d, "supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("suppkey"))
    values = Collection.of(partsupp(spark, d).join(suppliers, "suppkey", "left_semi")).sums(["partkey"], value=F.expr("cost * avail"))
    whole = values.sums([], total="value")
    return values.cross(whole).filter("value > total div 1000").df.select("partkey", "value")


@query(f"""WITH {_L}, {_O} SELECT l_linestatus, sum((o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT)::BIGINT AS high, sum((o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))::INT)::BIGINT AS low
 FROM l JOIN o ON l_orderkey = o_orderkey WHERE year(ship) = 1996 GROUP BY 1""")
def q12(spark, d):
    """Priorities by line status (in place of the ship mode)."""
    rows = lines(spark, d).where("year(ship) = 1996").join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return totals(rows, ["l_linestatus"], high=high.cast("long"), low=(~high).cast("long"))


@query("""SELECT orders, count(*)::BIGINT AS customers FROM (SELECT c_custkey, count(o_orderkey)::BIGINT AS orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority NOT LIKE '%5%') ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1""")
def q13(spark, d):
    """Customers by number of orders, none included; the pattern is on the priority."""
    kept = table(spark, d, "orders").where(~F.col("o_orderpriority").rlike("5")).select(F.col("o_custkey").alias("c_custkey"))
    counts = Collection.of(kept).concat(Collection.of(table(spark, d, "customer").select("c_custkey"))).count("n")
    return counts.map((F.col("n") - 1).alias("orders")).count("customers").df.drop(W)


@query(f"""WITH {_L} SELECT sum(CASE WHEN p_type LIKE 'PROMO%' THEN cents * (100 - disc) ELSE 0 END)::BIGINT AS promo, sum(cents * (100 - disc))::BIGINT AS total FROM l JOIN part ON p_partkey = l_partkey
 WHERE ship >= DATE '1996-09-01' AND ship < DATE '1996-10-01'""")
def q14(spark, d):
    rows = lines(spark, d).where("ship >= DATE '1996-09-01' AND ship < DATE '1996-10-01'").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return totals(rows, [], promo=F.when(F.col("p_type").startswith("PROMO"), money()).otherwise(0), total=money())


@query(f"""WITH {_L}, r AS (SELECT l_suppkey, sum(cents * (100 - disc))::BIGINT AS revenue FROM l WHERE ship >= DATE '1996-01-01' AND ship < DATE '1996-04-01' GROUP BY 1)
 SELECT s_suppkey, s_name, revenue FROM r JOIN supplier ON s_suppkey = l_suppkey WHERE revenue = (SELECT max(revenue) FROM r)""")
def q15(spark, d):
    rows = Collection.of(lines(spark, d).where("ship >= DATE '1996-01-01' AND ship < DATE '1996-04-01'"))
    best = rows.sums(["l_suppkey"], revenue=money()).first_with_ties([], "revenue", largest=True)
    return best.df.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "revenue")


@query(f"""WITH {_L}, {_PS} SELECT p_brand, p_type, p_size, count(*)::BIGINT AS n FROM ps JOIN part ON p_partkey = partkey WHERE p_type <> 'PROMO' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
 AND suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""")
def q16(spark, d):
    """Supplier counts by part properties; suppliers in debt (in place of complaints) don't count."""
    parts = table(spark, d, "part").where("p_type <> 'PROMO'").where(F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49))
    bad = Collection.of(table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("suppkey")), True)
    offers = Collection.of(partsupp(spark, d).join(parts, F.col("partkey") == F.col("p_partkey")).select("suppkey", "partkey", "p_brand", "p_type", "p_size"), True)
    return offers.antijoin(bad, ["suppkey"]).map("p_brand", "p_type", "p_size").count("n").df.drop(W)


@query(f"""WITH {_L}, x AS (SELECT l_partkey, qty, cents FROM l JOIN part ON p_partkey = l_partkey WHERE p_size = 23), t AS (SELECT l_partkey, sum(qty) AS total, count(*) AS n FROM x GROUP BY 1)
 SELECT sum(cents)::BIGINT AS cents FROM x JOIN t USING (l_partkey) WHERE 5 * qty * n < total""")
def q17(spark, d):
    """Revenue of lines with under a fifth of their part's mean quantity; the part filter is on the size."""
    parts = table(spark, d, "part").where("p_size = 23").select(F.col("p_partkey").alias("l_partkey"))
    rows = Collection.of(lines(spark, d).join(parts, "l_partkey", "left_semi").select("l_orderkey", "l_partkey", "qty", "cents"))
    sums = rows.sums(["l_partkey"], total="qty", n=F.lit(1))
    return rows.join(sums, ["l_partkey"]).filter("5 * qty * n < total").sums([], cents="cents").df.drop(W)


@query(f"""WITH {_L}, {_O}, b AS (SELECT l_orderkey, sum(qty)::BIGINT AS qty FROM l GROUP BY 1 HAVING sum(qty) > 300) SELECT c_custkey, c_name, o_orderkey, strftime(day, '%Y%m%d')::INT AS day, qty FROM b JOIN o ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def q18(spark, d):
    big = Collection.of(lines(spark, d)).sums(["l_orderkey"], qty="qty").filter("qty > 300")
    rows = big.df.join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_custkey", "c_name", "o_orderkey", packed("day").alias("day"), "qty")


@query(f"""WITH {_L}, x AS (SELECT * FROM l JOIN part ON p_partkey = l_partkey), u AS (SELECT * FROM x WHERE p_brand LIKE 'Brand#1%' AND qty BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5
 UNION ALL SELECT * FROM x WHERE p_brand LIKE 'Brand#2%' AND qty BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10 UNION ALL SELECT * FROM x WHERE p_brand LIKE 'Brand#3%' AND qty BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)
 SELECT sum(cents * (100 - disc))::BIGINT AS revenue FROM u""")
def q19(spark, d):
    """Three alternatives added up; prefixes of the brand stand for brand and container."""
    rows = Collection.of(lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")))
    some = lambda b, q, s: rows.filter(f"p_brand LIKE 'Brand#{b}%' AND qty BETWEEN {q} AND {q + 10} AND p_size BETWEEN 1 AND {s}")
    return some(1, 1, 5).concat(some(2, 10, 10), some(3, 20, 15)).sums([], revenue=money()).df.drop(W)


@query(f"""WITH {_L}, {_PS}, q AS (SELECT l_partkey, l_suppkey, sum(qty) AS qty FROM l WHERE year(ship) = 1996 GROUP BY 1, 2),
 g AS (SELECT suppkey, count(*)::BIGINT AS w FROM ps JOIN part ON p_partkey = partkey JOIN q ON l_partkey = partkey AND l_suppkey = suppkey WHERE p_size = 10 AND 2 * avail > q.qty GROUP BY 1)
 SELECT s_suppkey, s_name, w FROM g JOIN supplier ON s_suppkey = suppkey WHERE s_nationkey < 5""")
def q20(spark, d):
    """Suppliers with much of a part, each as often as it has such parts; partsupp is made from lineitem."""
    sold = lines(spark, d).where("year(ship) = 1996").groupBy(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).agg(F.sum("qty").alias("sold"))
    parts = table(spark, d, "part").where("p_size = 10").select(F.col("p_partkey").alias("partkey"))
    good = partsupp(spark, d).join(parts, "partkey", "left_semi").join(sold, ["partkey", "suppkey"]).where("2 * avail > sold")
    suppliers = Collection.of(table(spark, d, "supplier").where("s_nationkey < 5").select("s_suppkey", "s_name"), True)
    return suppliers.semijoin(Collection.of(good.select(F.col("suppkey").alias("s_suppkey"))), ["s_suppkey"]).df.withColumnRenamed(W, "w")


@query(f"""WITH {_L}, s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS late, count(*) AS n, max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS who FROM l GROUP BY 1)
 SELECT s_suppkey, s_name, count(*)::BIGINT AS n FROM s JOIN supplier ON s_suppkey = who WHERE late = 1 AND s.n > 1 GROUP BY 1, 2""")
def q21(spark, d):
    """Suppliers whose line was the only returned (in place of late) one of an order with others."""
    late = F.col("l_returnflag") == "R"
    per = lines(spark, d).groupBy("l_orderkey").agg(F.count_if(late).alias("late"), F.count(F.lit(1)).alias("n"), F.max(F.when(late, F.col("l_suppkey"))).alias("s_suppkey"))
    guilty = Collection.of(per.where("late = 1 AND n > 1").select("s_suppkey")).count("n")
    return guilty.df.join(table(spark, d, "supplier"), "s_suppkey").select("s_suppkey", "s_name", "n")


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS code, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer WHERE c_nationkey < 7), a AS (SELECT code, sum(bal)::BIGINT AS s, count(*) AS n FROM c WHERE bal > 0 GROUP BY 1)
 SELECT code, count(*)::BIGINT AS n, sum(bal)::BIGINT AS total FROM c JOIN a USING (code) WHERE bal * a.n > s AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def q22(spark, d):
    """Customers above their country's mean balance without urgent orders; the nation stands for the phone code, and urgent orders for all, which no customer lacks."""
    mine = Collection.of(table(spark, d, "customer").where("c_nationkey < 7").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("code"), F.round(F.col("c_acctbal") * 100).cast("long").alias("bal")), True)
    mean = mine.filter("bal > 0").sums(["code"], s="bal", n=F.lit(1))
    ordered = Collection.of(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))).distinct()
    return mine.antijoin(ordered, ["k"]).join(mean, ["code"]).filter("bal * n > s").sums(["code"], n=F.lit(1), total="bal").df.drop(W)
