"""A session: named inputs that change by ticks, installed programs, and published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...collection import W
from ...sources.inputs import recipe
from .parser import parse
from .run import evaluate, rows
from .tree import sources


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.epoch = spark, 0
        self.fed: dict[int, list[tuple]] = {}
        self.programs: dict[str, tuple] = {}
        self.published: dict[str, str] = {}
        self.results: dict[str, DataFrame] = {}
        self.made: dict[str, DataFrame] = {}

    def feed(self, position: int, key: tuple, value: tuple = (), weight: int = 1, time: int | None = None) -> None:
        """An update of an input, now or at a later time; never before the current epoch."""
        time = self.epoch if time is None else time
        if time < self.epoch:
            raise ValueError(f"time {time} lies before epoch {self.epoch}")
        self.fed.setdefault(position, []).append((list(key), list(value), weight, time))

    def install(self, name: str, text: str) -> None:
        """Adds a program. What it imports must be published, a recipe, or `clock`."""
        scope = parse(text)
        if name in self.programs:
            raise ValueError(f"{name} is installed already")
        taken = [x for x in scope.exports if x in self.published]
        if taken:
            raise ValueError(f"published already: {taken}")
        for x in sources(scope)[1]:
            if x not in self.published and x != "clock" and x not in self.made:
                made = recipe(self.spark, x)
                self.made[x] = rows(made, made.columns)
        self.programs[name] = (scope, sources(scope)[1])
        self.published |= dict.fromkeys(scope.exports, name)

    def drop(self, name: str) -> None:
        """Removes a program, unless another one imports what it publishes."""
        mine = {x for x, owner in self.published.items() if owner == name}
        users = [p for p, (_, imports) in self.programs.items() if p != name and imports & mine]
        if users:
            raise ValueError(f"{name} is imported by {users}")
        del self.programs[name]
        for x in mine:
            del self.published[x]
            self.results.pop(x, None)

    def list(self) -> dict[str, list[str]]:
        return {p: sorted(x for x, owner in self.published.items() if owner == p) for p in self.programs}

    def tick(self) -> int:
        """Closes the current epoch: programs see all updates up to it."""
        schema = f"key array<long>, val array<long>, {W} long, t long"
        inputs: dict = {p: self.spark.createDataFrame([u for u in log if u[3] <= self.epoch], schema).drop("t") for p, log in self.fed.items()}
        inputs |= self.made
        inputs["clock"] = rows(self.spark.createDataFrame([(self.epoch,)], "e long"), ["e"])
        for scope, _ in self.programs.values():  # in the order of installation, which imports follow
            for position in sources(scope)[0]:
                inputs.setdefault(position, self.spark.createDataFrame([], schema).drop("t"))
            found = evaluate(scope, inputs)
            self.results |= found
            inputs |= found
        self.epoch += 1
        return self.epoch

    def peek(self, name: str) -> list[tuple]:
        """A published result as of the last closed epoch, sorted: (key, value, weight)."""
        if name not in self.results:
            raise KeyError(name)
        found = self.results[name].groupBy("key", "val").agg(F.sum(W).alias(W)).where(F.col(W) != 0)
        return sorted((tuple(r["key"]), tuple(r["val"]), r[W]) for r in found.collect())
