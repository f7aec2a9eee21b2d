"""Incremental maintenance, one epoch at a time.

A maintained operator keeps its inputs' changes as a table for each epoch, and
every COMPACT_EVERY epochs their sum. It turns an epoch's input changes into its
output changes. Linear operators need no state. A join's change is
dA * B + A' * dB (A' being A with its change); a reduction is redone for the keys
that changed, before and after.

The state before an epoch is what the folder has of earlier epochs, so an epoch
that is tried again gives the same result, and a new process goes on where the
last one ended. A table counts once Spark has marked it as complete.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import W, Collection
from ..storage import complete


#: Epochs whose changes are added up at a time.
COMPACT_EVERY = 16


class State:
    """A collection's history in a shared folder: a table of changes for each epoch, and sums of all up to some epochs."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.folder, self.schema, self.compact_every = spark, folder, schema, compact_every

    def _complete(self, kind: str) -> list[int]:
        """The epochs of the complete tables of a kind, in order."""
        return complete(self.spark, self.folder, kind)

    def before(self, epoch: int) -> Collection:
        """The contents just before an epoch, not consolidated."""
        schema = f"{self.schema}, {W} long"
        base = max((e for e in self._complete("sum") if e < epoch), default=None)
        paths = [f"{self.folder}/sum={base}"] if base is not None else []
        paths += [f"{self.folder}/epoch={e}" for e in self._complete("epoch") if e < epoch and (base is None or e > base)]
        if not paths:
            return Collection(self.spark.createDataFrame([], schema))
        return Collection(self.spark.read.schema(schema).parquet(*paths))

    def advance(self, epoch: int, change: Collection) -> Collection:
        """Keeps an epoch's change; returns the contents after it, not consolidated."""
        old = self.before(epoch)
        names = [x.split()[0] for x in self.schema.split(", ")]
        change.consolidate().df.select(*names, W).write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")
        kept = Collection(self.spark.read.schema(f"{self.schema}, {W} long").parquet(f"{self.folder}/epoch={epoch}"))
        base = max((e for e in self._complete("sum") if e < epoch), default=None)
        if len([e for e in self._complete("epoch") if e <= epoch and (base is None or e > base)]) >= self.compact_every:
            old.concat(kept).consolidate().df.select(*names, W).write.mode("overwrite").parquet(f"{self.folder}/sum={epoch}")
        return old.concat(kept)


class Join:
    def __init__(self, spark: SparkSession, folder: str, left: str, right: str, on: Sequence[str]):
        self.left, self.right = State(spark, f"{folder}/left", left), State(spark, f"{folder}/right", right)
        self.on = list(on)

    def step(self, epoch: int, left: Collection, right: Collection) -> Collection:
        """The change of the join by changes of both sides."""
        old_right = self.right.before(epoch)
        new_left = self.left.advance(epoch, left)
        out = left.join(old_right, self.on).concat(new_left.join(right, self.on))
        self.right.advance(epoch, right)
        return out.consolidate()


class Reduce:
    """Any reduction of a whole collection by key, given as a function from collection to collection."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], reduction: Callable[[Collection], Collection], compact_every: int = COMPACT_EVERY):
        self.state, self.keys, self.reduction = State(spark, f"{folder}/in", schema, compact_every), list(keys), reduction

    def step(self, epoch: int, change: Collection) -> Collection:
        touched = Collection.of(change.df.select(*self.keys).distinct(), True)
        before = self.reduction(self.state.before(epoch).semijoin(touched, self.keys))
        after = self.reduction(self.state.advance(epoch, change).semijoin(touched, self.keys))
        return after.subtract(before).consolidate()


def stream(changes: DataFrame, step: Callable[[Collection, int], Collection], sink: str, checkpoint: str):
    """Runs step for each micro-batch of a stream of changes and writes the output's changes to sink.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        step(Collection(df), epoch).df.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def by_epoch(collection: Collection, time: str = "__t") -> list[tuple[int, Collection]]:
    """An evolving collection as its epochs' changes, in order."""
    return [(t, Collection(collection.df.where(F.col(time) == t).drop(time))) for t in collection.epochs()]
