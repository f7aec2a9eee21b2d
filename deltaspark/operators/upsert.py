"""Collections from upserts: each event sets a key's value at a time, or deletes the key (null)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..collection import T, W, Collection


def from_upserts(events: DataFrame, keys: Sequence[str], value: str, time: str = T) -> Collection:
    """Changes (keys.., value, __t, __w) of the collection that the events describe.

    Of several events of a key at one time the greatest value wins, null being
    the least; setting a value that is held already changes nothing.
    """
    settled = events.groupBy(*keys, F.col(time).cast("long").alias(T)).agg(F.max(value).alias("__new"))
    old = F.lag("__new").over(Window.partitionBy(*keys).orderBy(T))
    changed = settled.withColumn("__old", old).where(~F.col("__new").eqNullSafe(F.col("__old")))
    both = F.array(F.struct(F.col("__old").alias(value), F.lit(-1).alias(W)), F.struct(F.col("__new").alias(value), F.lit(1).alias(W)))
    rows = changed.select(*keys, T, F.inline(both)).where(F.col(value).isNotNull())
    return Collection(rows.select(*keys, value, T, F.col(W).cast("long").alias(W)))
