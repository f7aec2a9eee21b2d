"""A durable change protocol: update rows and progress statements, in any order and any number of times.

A progress statement for the interval [lower, upper) lists how many different
updates each of its times has. An update is released once statements cover all
times up to its own and all updates that they announce have arrived, so lost,
late and repeated messages never show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import T, W, Collection
from ..storage import complete

_PROGRESS = "lower long, upper long, time long, count long"


def write(collection: Collection, folder: str, lower: int, upper: int) -> None:
    """Appends the consolidated updates with times in [lower, upper), and then their progress."""
    own = collection.filter((F.col(T) >= lower) & (F.col(T) < upper)).consolidate().df
    own.write.mode("append").parquet(f"{folder}/updates")
    stated = own.groupBy(F.col(T).alias("time")).agg(F.count(F.lit(1)).alias("count"))
    marks = own.sparkSession.createDataFrame([(lower, upper, None, 0)], _PROGRESS)
    stated = stated.select(F.lit(lower).cast("long").alias("lower"), F.lit(upper).cast("long").alias("upper"), "time", "count")
    marks.unionByName(stated).write.mode("append").parquet(f"{folder}/progress")


def frontier(updates: DataFrame, progress: DataFrame, start: int = 0) -> int:
    """The first time about which something may still arrive."""
    # one row for each statement beyond start and for each time that is short of updates; both few beside the updates
    updates, progress = updates.where(F.col(T) >= start), progress.where(F.col("upper") > start)
    covered = start
    for lower, upper in sorted({(r["lower"], r["upper"]) for r in progress.select("lower", "upper").distinct().collect()}):
        if lower <= covered:
            covered = max(covered, upper)
    have = updates.groupBy(F.col(T).alias("time")).agg(F.count(F.lit(1)).alias("have"))
    stated = progress.where(F.col("time") >= start).groupBy("time").agg(F.max("count").alias("count"))
    short = stated.join(have, "time", "left").where(F.coalesce("have", F.lit(0)) < F.col("count")).agg(F.min("time")).first()[0]
    return covered if short is None else min(covered, short)


def released(updates: DataFrame, progress: DataFrame, start: int = 0) -> Collection:
    """The updates that are complete, once each, from any number of copies in any order."""
    once = updates.distinct()
    return Collection(once.where(F.col(T) < frontier(once, progress.distinct(), start)))


def read(spark: SparkSession, folder: str, start: int = 0) -> Collection:
    return released(spark.read.parquet(f"{folder}/updates"), spark.read.parquet(f"{folder}/progress"), start)


def sink(changes: DataFrame, folder: str, checkpoint: str):
    """Writes a stream of changes (data and __w) as messages; each micro-batch is one time.

    A micro-batch that is repeated repeats its messages, which readers pass over.
    """

    def batch(df: DataFrame, time: int) -> None:
        write(Collection(df.withColumn(T, F.lit(time).cast("long"))), folder, time, time + 1)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def follow(spark: SparkSession, folder: str, schema: str, out: str, start: int = 0) -> tuple[int, int]:
    """Releases to `out` what has become complete since the last call; returns the times [lower, upper) of it.

    Each release is a table `until=upper`. One that was broken off doesn't count and is made again,
    and a new process goes on after the last that counts.
    """
    lower = max(complete(spark, out, "until"), default=start)
    updates = spark.read.schema(f"{schema}, {T} long, {W} long").parquet(f"{folder}/updates").where(F.col(T) >= lower).distinct()
    upper = frontier(updates, spark.read.schema(_PROGRESS).parquet(f"{folder}/progress").distinct(), lower)
    if upper > lower:
        updates.where(F.col(T) < upper).write.mode("overwrite").parquet(f"{out}/until={upper}")
    return lower, upper


def followed(spark: SparkSession, schema: str, out: str) -> Collection:
    """All that has been released so far."""
    schema = f"{schema}, {T} long, {W} long"
    paths = [f"{out}/until={n}" for n in complete(spark, out, "until")]
    return Collection(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))


def source(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, start: int = 0):
    """A stream that calls `follow` whenever messages of either kind arrive."""
    stated = spark.readStream.schema(_PROGRESS).parquet(f"{folder}/progress").select("lower")
    arrived = spark.readStream.schema(f"{schema}, {T} long, {W} long").parquet(f"{folder}/updates").select(F.col(T).alias("lower"))
    return stated.unionByName(arrived).writeStream.foreachBatch(lambda df, n: follow(spark, folder, schema, out, start)).option("checkpointLocation", checkpoint)
