"""Shared storage for the operators: checkpoints that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than this share of the rows count as hot: there are fewer than HOT_SHARE of them whatever the data.
HOT_SHARE = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="deltaspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """left joined to right, whose keys are unique; its column `weight` says how many rows of left have the key.

    Keys that hold more than 1/HOT_SHARE of the counted rows can't be more than HOT_SHARE, so they are
    broadcast; the rows of all others are exchanged. No task gets much more than that share by one key.
    Both sides are read twice, so they should be tables.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    bound = max(1, total // HOT_SHARE)
    hot, rest = right.where(F.col(weight) > bound), right.where(F.col(weight) <= bound)
    if hot.isEmpty():
        return left.join(right, list(on))
    here = left.join(F.broadcast(hot), list(on))
    there = left.join(F.broadcast(hot.select(*on)), list(on), "left_anti").join(rest, list(on))
    return here.unionByName(there)
