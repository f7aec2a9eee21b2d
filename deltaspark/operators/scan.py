"""Exclusive prefix combinations for any associative function, commutative or not.

Positions are dealt to aligned blocks of BLOCK positions. A block is combined on
its own, the blocks' totals are scanned in the same way, and every block starts
from what lies before it. So a group holds at most BLOCK positions at each level
however many rows a key has, there are log(positions) / log(BLOCK) levels, and
everything is built-in functions.

Null values count for nothing. Positions of a key should be distinct; repeats
are combined in the order of their values, within one group. Null keys are a key
of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 256


def prefix(df: DataFrame, position: str, value: str, combine: Callable[[Column, Column], Column], keys: Sequence[str] = (), name: str = "before", at: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The combination of all values of a key at smaller positions, null if there are none.

    Each row of df gets it as column `name`; with `at`, a table of keys and positions, its rows do instead.
    """
    keys = list(keys)
    kind = df.schema[value].dataType.simpleString()
    wanted = df if at is None else at
    rows = df.select(*keys, F.col(position).cast("long").alias("__p"), F.lit(1).alias("__q"), F.col(value).alias("__v"), *([F.struct(*df.columns).alias("__row")] if at is None else []))
    if at is not None:  # a location comes before the value that is there
        rows = rows.withColumn("__row", F.lit(None).cast(at.select(F.struct(*at.columns)).schema[0].dataType)).unionByName(
            at.select(*keys, F.col(position).cast("long").alias("__p"), F.lit(0).alias("__q"), F.lit(None).cast(kind).alias("__v"), F.struct(*at.columns).alias("__row")))
    least, most = rows.agg(F.min("__p"), F.max("__p")).first()
    if least is None:
        return wanted.withColumn(name, F.lit(None).cast(kind))

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b)).cast(kind)

    def scan(rows: DataFrame, carried: list[str], size: int) -> DataFrame:
        """rows (keys, __p from 0 below size, __v, carried) with what lies before each as __before."""
        items = F.array_sort(F.collect_list(F.struct("__p", *(["__q"] if carried else []), "__v", *carried)))
        own = rows.groupBy(*keys, F.expr(f"__p div {block}").alias("__b")).agg(items.alias("__items"))
        start = F.struct(F.lit(None).cast(kind).alias("acc"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda a, x: F.struct(both(a["acc"], x["__v"]).alias("acc"), F.array_append(a["out"], a["acc"]).alias("out"))
        own = own.withColumn("__s", F.aggregate("__items", start, step))
        outer = F.lit(None).cast(kind)
        if size > block:
            totals = own.select(*keys, F.col("__b").alias("__p"), F.col("__s.acc").alias("__v"))
            over = scan(totals, [], -(-size // block)).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__o"), F.col("__before").alias("__outer"))
            met = F.col("__b") == F.col("__o")
            for i, k in enumerate(keys):
                met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
            own, outer = own.join(over, met), F.col("__outer")
        pairs = F.zip_with("__items", F.col("__s.out"), lambda x, o: F.struct(x.alias("x"), o.alias("o")))
        flat = own.select(*keys, outer.alias("__outer"), F.explode(pairs).alias("__y"))
        return flat.select(*keys, "__y.x.*", both(F.col("__outer"), F.col("__y.o")).alias("__before"))

    found = scan(rows.withColumn("__p", F.col("__p") - least), ["__row"], most - least + 1)
    if at is not None:
        found = found.where("__q = 0")
    return found.select("__row.*", F.col("__before").alias(name))
