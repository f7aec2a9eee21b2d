"""Shared storage: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_OF_TASK = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in tests on one machine, a temporary folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
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


def complete(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers n of the tables `kind=n` in a folder that Spark has marked as complete, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(str(f.getPath().getParent().getName()).partition("=")[2]) for f in found)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for an exchange of so many rows, of which a task can keep its share in memory."""
    return max(partitions(spark), -(-rows // ROWS_OF_TASK))
