"""Inputs: sessions, static data, text files, and deterministic recipes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import T, W, Collection
from ..functions.hashing import gen_row


class InputSession:
    """An interactive collection: updates are buffered at a logical time that only advances.

    An update may lie in the future, but never before the session's time.
    """

    def __init__(self, spark: SparkSession, schema: str, time: int = 0):
        self.spark, self.schema, self.time = spark, schema, time
        self._buffer: list[tuple] = []
        self._log: DataFrame | None = None
        self.closed = False

    def update(self, row: tuple, weight: int = 1) -> None:
        self.update_at(row, self.time, weight)

    def update_at(self, row: tuple, time: int, weight: int = 1) -> None:
        if self.closed:
            raise ValueError("the session is closed")
        if time < self.time:
            raise ValueError(f"time {time} lies before the session's time {self.time}")
        self._buffer.append((*row, time, weight))

    def insert(self, row: tuple) -> None:
        self.update(row, 1)

    def remove(self, row: tuple) -> None:
        self.update(row, -1)

    def advance_to(self, time: int) -> None:
        if time < self.time:
            raise ValueError("time can't go back")
        self.time = time

    def flush(self) -> None:
        """Hands the buffered updates over to the collection's log."""
        if self._buffer:
            new = self.spark.createDataFrame(self._buffer, f"{self.schema}, {T} long, {W} long")
            self._log = new if self._log is None else self._log.unionByName(new)
            self._buffer = []

    def close(self) -> None:
        self.flush()
        self.closed = True

    def to_collection(self) -> Collection:
        """All flushed updates, with their times."""
        log = self._log if self._log is not None else self.spark.createDataFrame([], f"{self.schema}, {T} long, {W} long")
        return Collection(log)

    def complete(self) -> Collection:
        """The updates at times before the session's: nothing about them can change any more."""
        self.flush()
        return self.to_collection().filter(F.col(T) < self.time)


def text_edges(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """src, dst from lines of two numbers; lines that start with # are comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), separator)
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def labelled_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, label from lines of two numbers and a word."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), parts[2].alias("label"))


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "|") -> DataFrame:
    """Rows of a delimited file (a trailing separator is ignored), as .tbl and .facts files have them."""
    return spark.read.csv(path, sep=separator, schema=schema, enforceSchema=True, mode="PERMISSIVE")


def facts(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Tab-separated string columns."""
    return delimited(spark, path, ", ".join(f"{c} string" for c in columns), "\t").distinct()


def iota(spark: SparkSession, n: int, name: str = "k0") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def random_rows(spark: SparkSession, nodes: int, edges: int, arity: int = 2, seed: int = 0, first: int = 0) -> DataFrame:
    """k0 .. of `edges` deterministic rows; row e doesn't depend on how many there are."""
    rows = spark.range(first, first + edges)
    return rows.select(gen_row("id", nodes, arity, seed).alias("row")).select(*[F.col("row")[i].alias(f"k{i}") for i in range(arity)])


def sliding_window(spark: SparkSession, nodes: int, edges: int, rounds: int, seed: int = 0) -> Collection:
    """A changing graph: `edges` rows at time 0, then each round inserts the next row and removes the oldest."""
    start = random_rows(spark, nodes, edges, 2, seed).select("k0", "k1", F.lit(0).cast("long").alias(T), F.lit(1).cast("long").alias(W))
    later = spark.range(rounds)

    def moved(shift: int, weight: int) -> DataFrame:
        row = gen_row(F.col("id") + shift, nodes, 2, seed)
        return later.select(row[0].alias("k0"), row[1].alias("k1"), (F.col("id") + 1).alias(T), F.lit(weight).cast("long").alias(W))

    return Collection(start.unionByName(moved(edges, 1)).unionByName(moved(0, -1)))


def recipe(spark: SparkSession, text: str) -> DataFrame:
    """The rows of `iota:N` or `random:nodes=N,edges=E[,arity=A][,seed=S]`."""
    kind, _, rest = text.partition(":")
    if kind == "iota":
        return iota(spark, int(rest))
    if kind == "random":
        given = {k: int(v) for k, v in (x.split("=") for x in rest.split(","))}
        unknown = set(given) - {"nodes", "edges", "arity", "seed"}
        if unknown or not {"nodes", "edges"} <= set(given):
            raise ValueError(f"not a recipe: {text}")
        return random_rows(spark, **given)
    raise ValueError(f"not a recipe: {text}")


def static(spark: SparkSession, rows: Iterable, schema: str) -> Collection:
    return Collection.from_rows(spark, rows, schema)
