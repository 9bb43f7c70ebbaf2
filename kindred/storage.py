"""Tables that jobs of one operator share, in the folder that all executors see."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; there is no fallback, as a folder of one machine would not do on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its rows are then fixed,
    computed once, and survive the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` wrote, which nothing may read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(total: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def running(df: DataFrame, amount: Column, *order: str) -> DataFrame:
    """df with before, the sum of ``amount`` over the rows that come earlier by ``order``: a range
    sort, then the sums of the partitions before, so that no task sees all rows."""
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_amount", amount), "running")
    sums = placed.groupBy("_part").agg(F.sum("_amount")).orderBy("_part").collect()  # a row for each partition
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    inside = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = placed.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(table), "_part")
    return summed.withColumn("before", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start", "_amount")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with nth, 1 for the first row by ``order`` and on without gaps."""
    return running(df, F.lit(1), *order).withColumn("nth", F.col("before") + 1).drop("before")
