"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
#: Bytes of rows up to which a table may be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return _own[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage is cut, and lost executors don't matter to it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def small(df: DataFrame, row_bytes: int = 128) -> DataFrame:
    """The table marked for broadcast if its counted rows stay within BROADCAST_BYTES; otherwise a join shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with distinct keys and each one's place from 0 in the order of the key; ranges are numbered apart, so no task sees all rows."""
    ranged = written(df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(name, place).select(*df.columns, name)
