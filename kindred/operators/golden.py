"""One record for each cluster, field by field, with the record that each value came from.

A rule gives the order in which a cluster's members are asked for a field; the first that has a
value gives it. All fields are picked in one aggregation over (cluster, member) rows, whose
partial results are a value a field, so that a cluster of any size is merged in pieces
on all tasks.

Members that no record has are ignored; a field that no member has is null and has no source;
records outside of clusters are not in the result. The smallest id wins ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import missing

#: How values of a field are preferred: of the best survivor, the latest change, the longest text, the greatest number or the most members.
WAYS = ("survivor", "latest", "longest", "greatest", "most")


def preference(way: str, field: str, latest: str) -> Column:
    """What is greatest for the member whose value counts."""
    survivor = F.coalesce("survivor_score", F.lit(-1.0))
    if way == "survivor":
        return F.struct(survivor)
    if way == "latest":
        return F.struct(F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.col(latest))), F.lit(-(1 << 62))), survivor)
    if way == "longest":
        return F.struct(F.length(F.col(field).cast("string")), survivor)
    if way == "greatest":
        return F.struct(F.col(field), survivor)
    raise ValueError(f"unknown way {way}: one of {', '.join(WAYS)}")


def golden_records(members: DataFrame, records: DataFrame, ways: dict[str, str], latest: str = "last_modified_date") -> DataFrame:
    """cluster_id, n_members, each field of ``ways`` and sources, a map from fields to the record_id that gave the value.

    members: cluster_id and record_id. records: record_id, survivor_score and the fields."""
    rows = members.select("cluster_id", "record_id").join(records, "record_id")
    text = {f for f, kind in records.dtypes if kind == "string"}
    common = [f for f, way in ways.items() if way == "most"]
    best = [picked(F.when((missing(F.col(f)) if f in text else F.col(f)).isNotNull(), preference(way, f, latest)), f).alias(f"_{f}") for f, way in ways.items() if way != "most"]
    out = rows.groupBy("cluster_id").agg(F.count("*").alias("n_members"), *best)
    for f in common:
        value = missing(F.col(f)) if f in text else F.col(f)
        votes = rows.where(value.isNotNull()).groupBy("cluster_id", f).agg(F.count("*").alias("n"), F.min("record_id").alias("id"))
        top = votes.groupBy("cluster_id").agg(F.min_by(F.struct(F.col(f).alias("value"), "id"), F.struct((-F.col("n")).alias("n"), "id")).alias(f"_{f}"))
        out = out.join(top, "cluster_id", "left")
    sources = F.map_filter(F.create_map(*(x for f in ways for x in (F.lit(f), F.col(f"_{f}.id")))), lambda k, v: v.isNotNull())
    return out.select("cluster_id", "n_members", *(F.col(f"_{f}.value").alias(f) for f in ways), sources.alias("sources"))


def picked(order: Column, field: str) -> Column:
    """The value and record_id of the row with the greatest order that is not null; of equal ones, of the smallest id."""
    return F.max_by(F.struct(F.col(field).alias("value"), F.col("record_id").alias("id")), F.when(order.isNotNull(), F.struct(order.alias("order"), descending("record_id").alias("id"))))


def descending(column: str) -> Column:
    """Bytes that sort in the opposite order of a text's."""
    digits, turned = "0123456789ABCDEF", "FEDCBA9876543210"
    return F.concat(F.translate(F.hex(F.col(column).cast("binary")), digits, turned), F.lit("G"))


def merged(records: DataFrame, members: DataFrame, golden: DataFrame, survivors: DataFrame) -> DataFrame:
    """The table after the merges: each cluster's survivor with the golden values, records outside of clusters as they
    are, and merged_from, the ids that went into the row. survivors: cluster_id and survivor."""
    fields = [f for f in golden.columns if f in records.columns]
    kept = survivors.select("cluster_id", F.col("survivor").alias("record_id"))
    ids = members.groupBy("cluster_id").agg(F.sort_array(F.collect_set("record_id")).alias("merged_from"))
    new = golden.select("cluster_id", *(F.col(f).alias(f"_{f}") for f in fields))
    rows = records.join(kept.join(new, "cluster_id").join(ids, "cluster_id"), "record_id")
    rows = rows.select(*(F.col(f"_{c}").alias(c) if c in fields else F.col(c) for c in records.columns), "merged_from")
    alone = records.join(members.select("record_id").distinct(), "record_id", "left_anti")
    return rows.unionByName(alone.withColumn("merged_from", F.array("record_id")))
