"""Sessions and tumbling windows of events, and what they say about the activity of a key.

Events of a key that lie in one slot of ``gap_seconds`` belong to one session, so that slots are summed
first, on the map side too; sessions are then read off the slots in their order. What is
sorted by key follows the time that the events span and not their number, and a key with a third of all
events is not one task's. Events without key or time count nowhere; repeated ones count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import quality


def _usable(rows: DataFrame, by: str, time: str) -> DataFrame:
    return rows.withColumn("_at", F.col(time).cast("timestamp")).where(F.col(by).isNotNull() & F.col("_at").isNotNull())


def _counts(counts: dict[str, Column] | None) -> list[Column]:
    return [F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in (counts or {}).items()]


def sessions(rows: DataFrame, by: str, time: str, gap_seconds: int, counts: dict[str, Column] | None = None) -> DataFrame:
    """by, session (from 1 in each key), started, ended, n and, for each of ``counts``, how many events meet it.

    A session ends where more than ``gap_seconds`` pass without an event."""
    gap = gap_seconds * 1_000_000
    more = list(counts or {})
    slots = _usable(rows, by, time).groupBy(by, F.floor(F.unix_micros("_at") / gap).alias("_slot")).agg(F.min("_at").alias("started"), F.max("_at").alias("ended"), F.count("*").alias("n"), *_counts(counts))
    order = Window.partitionBy(by).orderBy("_slot")
    pause = F.unix_micros("started") - F.unix_micros(F.lag("ended").over(order))
    numbered = slots.withColumn("_fresh", F.coalesce((pause > gap).cast("long"), F.lit(1))).withColumn("session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(by, "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), *(F.sum(x).alias(x) for x in ("n", *more)))


def tumbling(rows: DataFrame, by: str, time: str, width: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """by, started (of the window of ``width`` that begins at a multiple of it), n and ``counts``."""
    return _usable(rows, by, time).groupBy(by, F.window("_at", width).alias("_window")).agg(F.count("*").alias("n"), *_counts(counts)).select(by, F.col("_window.start").alias("started"), "n", *(counts or {}))


def activity(found: DataFrame, by: str, as_of: str) -> DataFrame:
    """Of each key with sessions: n_sessions, last_activity_date as records have it, and the recency and engagement that follow."""
    last = found.groupBy(by).agg(F.count("*").alias("n_sessions"), F.max("ended").alias("ended"))
    last = last.select(by, "n_sessions", F.date_format("ended", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_activity_date"))
    none = F.lit(None).cast("string")
    return last.withColumn("recency", quality.recency(F.col("last_activity_date"), as_of)).withColumn("engagement", quality.engagement(F.col("last_activity_date"), none, none, (), ()))
