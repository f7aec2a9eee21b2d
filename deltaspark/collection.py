"""Collections: multisets that may change over time, as DataFrames.

A Collection is a DataFrame of data columns, a weight `__w` (long) and, if it
is timed, a logical time `__t` (long). A row says that the multiplicity of its
data changes by `__w` at `__t`; an untimed collection is one moment's contents.
All methods only build DataFrames, so Catalyst plans whole programs.

`unit` promises that rows are distinct with weight 1. It lets semijoin,
antijoin and distinct use Spark's plain operators instead of weight arithmetic.

Timed collections have a totally ordered time, and reductions report, for each
time at which a key changes, the retraction of the old result and the new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W, T = "__w", "__t"
_FOREVER = (1 << 63) - 1


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Collection:
    def __init__(self, df: DataFrame, unit: bool = False):
        self.df, self.unit = df, unit
        self.timed = T in df.columns
        self.data = [c for c in df.columns if c not in (W, T)]

    # -- sources ---------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, unit: bool = False) -> Collection:
        """Rows of df, each with weight 1, at the least time."""
        return cls(df.withColumn(W, F.lit(1).cast("long")), unit)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable, schema: str) -> Collection:
        return cls.of(spark.createDataFrame(list(rows), schema))

    @classmethod
    def from_raw(cls, spark: SparkSession, updates: Iterable, schema: str) -> Collection:
        """Updates given as (data.., time, weight)."""
        return cls(spark.createDataFrame(list(updates), f"{schema}, {T} long, {W} long"))

    def _carry(self) -> list[str]:
        return [T, W] if self.timed else [W]

    def _new(self, df: DataFrame, unit: bool = False) -> Collection:
        return Collection(df, unit)

    # -- per-record operators ---------------------------------------------

    def map(self, *columns: str | Column) -> Collection:
        """Data columns become these; weights and times stay."""
        return self._new(self.df.select(*columns, *self._carry()))

    def filter(self, condition: str | Column) -> Collection:
        return self._new(self.df.where(condition), self.unit)

    def flat_map(self, array: str | Column, name: str, *keep: str | Column) -> Collection:
        """One record for each element of an array expression, with the columns `keep`."""
        return self._new(self.df.select(*keep, F.explode(_col(array)).alias(name), *self._carry()))

    def flat_map_positions(self, array: str | Column, position: str, name: str, *keep: str | Column) -> Collection:
        return self._new(self.df.select(*keep, F.posexplode(_col(array)).alias(position, name), *self._carry()))

    def explode(self, weight: str | Column, *columns: str | Column) -> Collection:
        """Moves a measure into the weight: the new weight is `weight` times the old one."""
        return self._new(self.df.select(*columns, *([T] if self.timed else []), (_col(weight) * F.col(W)).cast("long").alias(W)))

    def join_function(self, columns: Sequence[str | Column], time: str | Column, weight: str | Column) -> Collection:
        """Records take effect no earlier than `time` and with `weight` times their weight."""
        start = F.greatest(F.col(T), _col(time)) if self.timed else _col(time)
        return self._new(self.df.select(*columns, start.cast("long").alias(T), (_col(weight) * F.col(W)).cast("long").alias(W)))

    def negate(self) -> Collection:
        return self._new(self.df.withColumn(W, -F.col(W)))

    def delay(self, time: str | Column) -> Collection:
        """Advances times by a monotone expression of __t; a time never goes back."""
        return self._new(self.df.withColumn(T, F.greatest(F.col(T), _col(time).cast("long"))))

    def inspect(self, observation) -> Collection:
        """Counts updates as they pass, in a pyspark Observation."""
        return self._new(self.df.observe(observation, F.count(F.lit(1)).alias("updates"), F.sum(W).alias("weight")), self.unit)

    # -- sets ---------------------------------------------------------------

    def concat(self, *others: Collection) -> Collection:
        return self._new(fold(DataFrame.unionByName, [x.df for x in others], self.df))

    def subtract(self, other: Collection) -> Collection:
        """Weights may become negative; nothing is clamped."""
        return self.concat(other.negate())

    def consolidate(self) -> Collection:
        """At most one update for each (data, time), none of weight zero."""
        if self.unit:
            return self
        keys = [*self.data, *([T] if self.timed else [])]
        return self._new(self.df.groupBy(*keys).agg(F.sum(W).alias(W)).where(F.col(W) != 0))

    def union(self, *others: Collection) -> Collection:
        """Set union."""
        return self.concat(*others).distinct()

    def intersect(self, other: Collection) -> Collection:
        """Records of both, once."""
        return self.distinct().semijoin(other.distinct(), self.data)

    # -- time ----------------------------------------------------------------

    def snapshot(self, time: int) -> Collection:
        """The contents at a time: all updates up to it, accumulated."""
        return self._new(self.df.where(F.col(T) <= time).drop(T)).consolidate()

    def between(self, since: int, until: int) -> Collection:
        """Updates before `until`, with the history before `since` folded into that time."""
        return self.compact(since).filter(F.col(T) < until)

    def compact(self, since: int) -> Collection:
        return self._new(self.df.withColumn(T, F.greatest(F.col(T), F.lit(since).cast("long")))).consolidate()

    def differentiate(self) -> Collection:
        """Each record holds only at the moment of its update."""
        gone = self._new(self.df.withColumn(T, F.col(T) + 1)).negate()
        return self.concat(gone)

    def integrate(self, until: int) -> Collection:
        """The reverse: moments become updates, by cancelling what ends where the next begins."""
        total = F.sum(W).over(Window.partitionBy(*self.data).orderBy(T).rowsBetween(Window.unboundedPreceding, 0))
        return self._new(self.consolidate().df.select(*self.data, T, total.alias(W)).where(F.col(W) != 0).where(F.col(T) < until))

    def epochs(self) -> list[int]:
        """The times at which something changes; as many as epochs, not as records."""
        return sorted(r[0] for r in self.df.select(T).distinct().collect())

    # -- joins -----------------------------------------------------------------

    def join(self, other: Collection, on: Sequence[str]) -> Collection:
        """Equi-join on columns of the same names; weights multiply, times join."""
        right = other.df.withColumnsRenamed({W: "__w2", T: "__t2"})
        joined = self.df.join(right, list(on))
        data = [*on, *(c for c in self.data if c not in on), *(c for c in other.data if c not in on)]
        times = [F.col(x) for x, y in ((T, self), ("__t2", other)) if y.timed]
        time = [F.greatest(*times).alias(T)] if len(times) == 2 else [times[0].alias(T)] if times else []
        return self._new(joined.select(*data, *time, (F.col(W) * F.col("__w2")).alias(W)))

    def join_map(self, other: Collection, on: Sequence[str], *columns: str | Column) -> Collection:
        return self.join(other, on).map(*columns)

    def semijoin(self, keys: Collection, on: Sequence[str]) -> Collection:
        """Records whose key is in `keys`; weights multiply unless the keys are known to be distinct."""
        if keys.unit and not keys.timed:
            return self._new(self.df.join(keys.df.select(*on), list(on), "left_semi").select(*self.df.columns), self.unit)
        own = keys.map(*on).consolidate()
        return self._new(self.join(own, on).map(*self.data).df)

    def antijoin(self, keys: Collection, on: Sequence[str]) -> Collection:
        """self minus its semijoin; weights can become negative if keys repeat."""
        if keys.unit and not keys.timed:
            return self._new(self.df.join(keys.df.select(*on), list(on), "left_anti").select(*self.df.columns), self.unit)
        return self.subtract(self.semijoin(keys, on)).consolidate()

    def cross(self, other: Collection) -> Collection:
        """All pairs; meant for a collection of one record, such as a global total, which Spark then broadcasts."""
        right = other.df.withColumnsRenamed({W: "__w2"})
        return self._new(self.df.crossJoin(right).withColumn(W, F.col(W) * F.col("__w2")).drop("__w2"))

    def lookup(self, requests: Collection, on: Sequence[str]) -> Collection:
        """For each request (timed, distinct records), the records of its key accumulated up to its time."""
        right = self.df.withColumnsRenamed({W: "__w2", T: "__t2"})
        met = requests.df.join(right, list(on)).where(F.col("__t2") <= F.col(T))
        data = [*requests.data, *(c for c in self.data if c not in on)]
        met = met.groupBy(*data, T, W).agg(F.sum("__w2").alias("__w2")).where("__w2 <> 0")
        return self._new(met.select(*data, T, (F.col(W) * F.col("__w2")).alias(W)))

    # -- reductions ---------------------------------------------------------------

    def _running(self, keys: Sequence[str]) -> DataFrame:
        """For each key and time of change: the accumulated weight before and after."""
        changes = self.df.groupBy(*keys, T).agg(F.sum(W).alias("__d")).where("__d <> 0")
        now = F.sum("__d").over(Window.partitionBy(*keys).orderBy(T).rowsBetween(Window.unboundedPreceding, 0))
        return changes.withColumn("__now", now).withColumn("__old", F.col("__now") - F.col("__d"))

    def count(self, name: str = "count", keys: Sequence[str] | None = None) -> Collection:
        """(record, accumulated weight) with weight 1; none where it is zero."""
        keys = list(keys if keys is not None else self.data)
        if not self.timed:
            return self._new(self.df.groupBy(*keys).agg(F.sum(W).alias(name)).where(F.col(name) != 0).withColumn(W, F.lit(1).cast("long")), True)
        both = F.array(F.struct(F.col("__old").alias(name), F.lit(-1).alias(W)), F.struct(F.col("__now").alias(name), F.lit(1).alias(W)))
        rows = self._running(keys).select(*keys, T, F.inline(both)).where(F.col(name) != 0)
        return self._new(rows.select(*keys, name, T, F.col(W).cast("long").alias(W)))

    def threshold(self, weight: Callable[[Column], Column]) -> Collection:
        """New weight as a function of the accumulated one; it should be zero at zero."""
        if not self.timed:
            total = self.df.groupBy(*self.data).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
            return self._new(total.withColumn(W, weight(F.col(W)).cast("long")).where(F.col(W) != 0))
        f = lambda c: F.when(c == 0, 0).otherwise(weight(c)).cast("long")
        rows = self._running(self.data).select(*self.data, T, (f(F.col("__now")) - f(F.col("__old"))).alias(W))
        return self._new(rows.where(F.col(W) != 0))

    def threshold_changes(self, change: Callable[[Column, Column], Column]) -> Collection:
        """For each change of a record's accumulated weight, an output change as a function of the new and the old one (null if zero)."""
        if not self.timed:
            total = self.df.groupBy(*self.data).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
            return self._new(total.withColumn(W, change(F.col(W), F.lit(None).cast("long")).cast("long")).where(F.col(W) != 0))
        old = F.when(F.col("__old") != 0, F.col("__old"))
        rows = self._running(self.data).select(*self.data, T, change(F.col("__now"), old).cast("long").alias(W))
        return self._new(rows.where(F.col(W) != 0))

    def distinct(self) -> Collection:
        """Weight 1 for each record whose accumulated weight isn't zero."""
        if self.unit:
            return self
        out = self.threshold(lambda w: F.lit(1))
        return self._new(out.df, not self.timed)

    def aggregate(self, keys: Sequence[str], *columns: Column) -> Collection:
        """Built-in aggregates for each key, over records of positive weight 1 (see `sums` for weighted ones)."""
        return self._new(self.df.groupBy(*keys).agg(*columns).withColumn(W, F.lit(1).cast("long")), True)

    def sums(self, keys: Sequence[str], **measures: str | Column) -> Collection:
        """Several weighted sums in one pass: each measure times the weight."""
        return self.aggregate(keys, *[F.sum(_col(m) * F.col(W)).alias(n) for n, m in measures.items()])

    def _present(self) -> DataFrame:
        return self.df if self.unit else self.consolidate().df

    def min(self, keys: Sequence[str], value: str, name: str | None = None) -> Collection:
        """The smallest value of each key whose accumulated weight isn't zero."""
        return Collection(self._present().groupBy(*keys).agg(F.min(value).alias(name or value)).withColumn(W, F.lit(1).cast("long")), True)

    def max(self, keys: Sequence[str], value: str, name: str | None = None) -> Collection:
        return Collection(self._present().groupBy(*keys).agg(F.max(value).alias(name or value)).withColumn(W, F.lit(1).cast("long")), True)

    def first_with_ties(self, keys: Sequence[str], order: str, largest: bool = False) -> Collection:
        """All records of each key that have the smallest (or largest) value."""
        best = F.max(order) if largest else F.min(order)
        own = self._present()
        marked = own.withColumn("__best", best.over(Window.partitionBy(*keys))) if keys else own.crossJoin(own.agg(best.alias("__best")))
        return self._new(marked.where(F.col(order) == F.col("__best")).drop("__best"))

    def collect(self, keys: Sequence[str], value: str, name: str = "values") -> Collection:
        """Sorted list of each key's values, each as often as its weight says."""
        own = self._present().where(F.col(W) > 0)
        many = own.select(*keys, F.explode(F.array_repeat(F.col(value), F.col(W).cast("int"))).alias("__v"))
        return Collection(many.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias(name)).withColumn(W, F.lit(1).cast("long")), True)

    def prefix_sum(self, position: str, value: str, keys: Sequence[str] = (), name: str = "sum") -> Collection:
        """Exclusive running sum of value in order of position, for each key.

        Without keys, positions are whole numbers and the sum is taken in blocks (see `prefix_combine`, also for hot keys).
        """
        if not keys:
            return self.prefix_combine(position, value, lambda a, b: a + b, (), name, 0)
        order = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        total = F.coalesce(F.sum(value).over(order), F.lit(0)).cast("long").alias(name)
        return self._new(self.df.select(*self.data, total, W))

    def prefix_combine(self, position: str, value: str, combine: Callable[[Column, Column], Column], keys: Sequence[str] = (), name: str = "before", zero: object = None) -> Collection:
        """Exclusive running combination in order of whole-number positions, by any associative function of two Columns."""
        from .operators.scan import prefix

        found = prefix(self.df, position, value, combine, keys, name)
        if zero is not None:
            found = found.withColumn(name, F.coalesce(F.col(name), F.lit(zero).cast(found.schema[name].dataType)))
        return self._new(found.select(*self.data, name, *self._carry()))

    def reduce(self, keys: Sequence[str], values: Sequence[str], function: Callable, schema: str, feedback: bool = False) -> Collection:
        """General reduction: function(key, [(value, weight), ..]) -> [(output, weight), ..], values in order.

        It sees only values of non-zero weight, and isn't called without any. For a timed
        collection it is called at each time at which its key changes.

        feedback: function(key, values, [(output, weight), ..]) also sees the key's output so far and
        returns changes of it; it is called without values too, as long as there is output.
        """
        keys, values = list(keys), list(values)
        names = [x.split()[0] for x in schema.split(",")] if schema else []
        key_schema = ", ".join(f"{k} {t}" for k, t in self.df.dtypes if k in keys)
        timed = self.timed

        def run(group: pd.DataFrame) -> pd.DataFrame:
            key = tuple(group[k].iloc[0] for k in keys)
            held: dict = {}
            out, old = [], {}
            moments = group.groupby(T, sort=True) if timed else [(0, group)]
            for time, part in moments:
                for *value, weight in part[[*values, W]].itertuples(index=False, name=None):
                    held[tuple(value)] = held.get(tuple(value), 0) + weight
                held = {v: w for v, w in held.items() if w}
                new: dict = {}
                if feedback:
                    new = dict(old)
                    made = function(key, sorted(held.items()), sorted(old.items())) if held or old else []
                else:
                    made = function(key, sorted(held.items())) if held else []
                for value, weight in made:
                    new[tuple(value)] = new.get(tuple(value), 0) + weight
                new = {v: w for v, w in new.items() if w}
                for value in {**old, **new}:
                    change = new.get(value, 0) - old.get(value, 0)
                    if change:
                        out.append((*key, *value, *([time] if timed else []), change))
                old = new
            return pd.DataFrame(out, columns=[*keys, *names, *([T] if timed else []), W])

        full = ", ".join(x for x in (key_schema, schema, f"{T} long" if timed else "", f"{W} long") if x)
        ordered = self.df.select(*keys, *values, *([T] if timed else []), W)
        return Collection(ordered.groupBy(*keys).applyInPandas(run, full))

    # -- arrangements ----------------------------------------------------------------

    def arrange(self, on: Sequence[str]) -> Collection:
        """The collection partitioned and sorted by key and held, for several uses on that key."""
        held = self.consolidate().df.repartition(*on).sortWithinPartitions(*on).persist()
        return Collection(held, self.unit)

    def release(self) -> None:
        self.df.unpersist()

    # -- results ------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """The data, each record as often as its weight says; negative weights are an error."""
        own = self.consolidate().df
        checked = F.when(F.col(W) >= 0, F.col(W)).otherwise(F.raise_error(F.lit("a record has negative weight")))
        many = own.select(*self.data, F.explode(F.array_repeat(F.lit(1), checked.cast("int"))).alias("__x"))
        return many.drop("__x")

    def assert_empty(self) -> None:
        left = self.consolidate().df.limit(5).collect()
        if left:
            raise AssertionError(f"not empty: {left}")

    def assert_eq(self, other: Collection) -> None:
        self.subtract(other).assert_empty()
