"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset, a session on one machine (tests) gets a temporary folder for it; on a cluster that is an error,
    as no machine's own folder is safe there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rentwire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rentwire-{uuid.uuid4().hex}"


def cut(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it: later jobs neither repeat its work nor depend on an executor's disk.

    scratch: gets the table's path, for ``discard`` once nothing reads it any more.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that ``cut`` wrote."""
    for path in scratch:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    scratch.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, *order: str, name: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` as a written table with a long ``name`` that rises with the order, range-sorted over all tasks; it has gaps."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return cut(ranged.withColumn(name, F.monotonically_increasing_id()), scratch)


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df`` with the number (from 1) of each row of a group in its order, as a written table.

    Rows are range-sorted over all tasks; a group's number starts where the tasks before left off, so that a group of any
    size is spread over tasks and only a row for each task and group is counted.
    """
    parts = partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, group, order).sortWithinPartitions(group, order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    runs = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(runs.withColumn("_before", before).drop("_n"), [group, "_part"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_before")
