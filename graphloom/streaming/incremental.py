"""Increments: what changed, what it touches, and streams that keep tables current.

The event-time operators at the end are an extension; the batch operators before them
are incremental by content hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.contracts import changed_files
from ..operators.traversal import reach


def to_parse(before: DataFrame, after: DataFrame, imports: DataFrame, hops: int = 4) -> DataFrame:
    """Files to parse again: changed and added ones, and what imports them, up to some hops. Tables: (path, hash); imports: (src, dst) files."""
    changed = changed_files(before, after).where("change <> 'removed' OR path IS NOT NULL").select(F.col("path").alias("id"))
    names = after.select(F.col("path").alias("id"), F.col("path").alias("name"))
    touched = reach(names, imports, changed, "up", hops).rows.select(F.col("id").alias("path"), "depth")
    return touched.join(after.select("path"), "path", "left_semi")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` whose key and hash were there before."""
    return after.join(before.select("path", "hash"), ["path", "hash"], "left_semi")


def stale(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages with the state of their evidence: fresh, stale or missing. Both sides: key, hash."""
    joined = pages.select("key", F.col("hash").alias("was")).join(evidence.select("key", F.col("hash").alias("now")), "key", "left")
    return joined.select("key", F.when(F.col("now").isNull(), "missing").when(F.col("was").eqNullSafe(F.col("now")), "fresh").otherwise("stale").alias("state"))


def start_upserts(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``merge(batch, number)`` on each micro-batch; a batch that is repeated after a failure has the same number, so merges can be exactly-once."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and the sum of their values a window and key, of streams (with a watermark) and of tables alike."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = own.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of events of one key without a gap: start, end of the last event's reach, number."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    counted = own.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """For each left row the value of the last right row of its key at or before its time, as one sort of both sides and no range join."""
    both = left.withColumn("is_left", F.lit(1)).withColumn("value_at", F.lit(None).cast(dict(right.dtypes)[value])).unionByName(
        right.select(key, time, F.col(value).alias("value_at")).withColumn("is_left", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy(time, "is_left").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("value_at", ignorenulls=True).over(order)
    return both.withColumn("value_at", last).where("is_left = 1").drop("is_left")
