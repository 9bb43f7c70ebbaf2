"""Rows joined with the latest earlier row of another table.

Both tables are united, sorted by key and time, and the last right row is carried
forward: one shuffle of each side and one sort, where a range join would make all
earlier rows of a key. A key with a third of all rows would be one task's, so that
keys are cut into spans of time: a span's rows are carried within it, and what a span begins
with is the last right row of the nearest span before that has one, a row for each key and span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], span_seconds: int = 86400, strict: bool = False) -> DataFrame:
    """left with ``values`` and ``right_time`` (as right_time) of the right row of the same key with the greatest time
    up to left_time, or before it if ``strict``; nulls where there is none, for null keys and null times.

    Of right rows at one time the one with the greatest values counts. Rows of left that repeat stay."""
    at = lambda side, time: F.col(time).cast("timestamp")
    given = F.struct(F.col(right_time).alias("_time"), *values)
    usable = lambda df, time: F.col(by).isNotNull() & at(df, time).isNotNull()
    rows = right.where(usable(right, right_time)).groupBy(by, at(right, right_time).alias("_at")).agg(F.max(given).alias("_given"))
    sides = left.withColumn("_key", F.when(usable(left, left_time), F.col(by))).withColumn("_left", F.struct(*(f"`{c}`" for c in left.columns)))
    none = sides.where("_key is null").select("_left", F.lit(None).cast(rows.schema["_given"].dataType).alias("_found"))
    sides = sides.where("_key is not null").select("_key", at(left, left_time).alias("_at"), "_left")
    both = sides.withColumn("_given", F.lit(None).cast(rows.schema["_given"].dataType)).unionByName(rows.select(F.col(by).alias("_key"), "_at", F.lit(None).cast(sides.schema["_left"].dataType).alias("_left"), "_given"))
    span = F.floor(F.unix_timestamp("_at") / span_seconds)
    both = both.withColumn("_span", span)
    # of rows at one time, right ones come first, or last if they do not count
    order = [F.col("_at"), (F.col("_left").isNotNull() != F.lit(strict)).cast("int")]
    last = lambda w: F.last("_given", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = both.withColumn("_found", last(Window.partitionBy("_key", "_span").orderBy(*order))).where("_left is not null")
    ends = rows.select(F.col(by).alias("_key"), F.floor(F.unix_timestamp("_at") / span_seconds).alias("_span"), "_at", "_given").groupBy("_key", "_span").agg(F.max_by("_given", "_at").alias("_given"))
    asked = sides.select("_key", F.floor(F.unix_timestamp("_at") / span_seconds).alias("_span")).distinct()
    spans = ends.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_given", F.lit(None).cast(rows.schema["_given"].dataType)).withColumn("_asked", F.lit(True)))
    # a span that is asked for comes before the same span's own end
    before = last(Window.partitionBy("_key").orderBy("_span", F.desc("_asked")))
    carried = spans.withColumn("_before", before).where("_asked").select("_key", "_span", "_before")
    found = inside.join(carried, ["_key", "_span"]).select("_left", F.coalesce("_found", "_before").alias("_found")).unionByName(none)
    return found.select("_left.*", F.col("_found._time").alias("right_time"), *(F.col(f"_found.{v}").alias(v) for v in values))
