"""Sharding by vector bin packing.

A group of documents with equal texts has a vector of bytes, tokens and rows, each as a
share of the whole. Large groups first, a group goes to the shard where the dot product of
its vector with the shard's residual capacity is highest; shards without room for it in all
sizes come second, and those without room for its bytes last, as the law is ``bytes``. A group stays whole unless it is larger than a shard's
share in some dimension; such a group is split over all shards.

How Spark runs it. Sizes and a 128-bit hash of the text leave the scan; texts are
not shuffled. Groups are placed by levels of their size: those above a 200th of a shard's
share, of which there can be no more than ``3 * 200 * shards``, in one task; then each
level of those up to 200 times smaller in slices, so many that a group is at most an eighth
of what a shard gets of a slice; the last level has slices of about ``slice_rows`` rows. Each
slice is placed into its part of the capacity that earlier levels left. Where the groups of
the first level went is broadcast, a table whose size the shares bound; no group, however
large, is in one task. Slots count up inside chunks of about ``slice_rows`` rows of a shard,
from offsets that are sums of counts.

Defined cases: null text has 0 bytes and is grouped with the empty text; rows with equal
doc_id and text are placed each; of groups of equal size the one with the greater hash goes
first, and of shards with equal products the first in an order that each slice turns on; a
text of any length counts whole; an empty table gives no rows; other columns are ignored; a
null doc_id is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import storage

SIZES = ["bytes", "tokens", "rows"]
#: Groups of a level are at most so many times smaller than those of the one before.
RATIO = 200
#: Pieces in which a shard gets its part of a group that is larger than a shard.
FINE = 8


def place(vectors: np.ndarray, room: np.ndarray, turn: int = 0) -> np.ndarray:
    """Shard of each vector (rows x dimensions), by the largest dot product with residual capacity
    ``room`` (shards x dimensions): of the shards with room for it in all dimensions, else in the first one, else of all."""
    shards = len(room)
    room = np.roll(room, -turn, axis=0)
    out = np.empty(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(1), kind="stable").tolist() if len(vectors) else []:
        x = vectors[i]
        fit = room @ x
        good = (room >= x).all(1)
        if not good.any():
            good = room[:, 0] >= x[0]
        best = int(np.argmax(np.where(good, fit, -np.inf) if good.any() else fit))
        out[i] = best
        room[best] -= x
    return (out + turn) % shards


def vector_shards(docs: DataFrame, shards: int = 24, slice_rows: int = 20_000) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law ('bytes'), shard, slot, grown_shard, n_tokens."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        tokens.alias("n_tokens"), F.unhex(F.md5(text.cast("binary"))).alias("same"), F.monotonically_increasing_id().alias("row"),
    )
    sized = storage.saved(sized, "sized")
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    total = sized.agg(*sums).first().asDict()
    slices = storage.parts(total["rows"], slice_rows)
    share = F.greatest(*(F.col(c) / float(total[c] or 1) for c in SIZES))
    groups = storage.saved(sized.groupBy("same").agg(*sums).withColumn("share", share), "groups")
    # groups above a shard's share: at most one for each shard and dimension
    divided = F.broadcast(groups.where(F.col("share") > 1 / shards).select("same", F.lit(True).alias("divided")))
    piece = F.when(F.col("divided"), F.pmod(F.xxhash64("row", F.lit(3)), F.lit(shards * FINE))).otherwise(0).cast("int")
    tagged = sized.join(divided, "same", "left").withColumn("piece", piece)
    pieces = tagged.where("divided").groupBy("same", "piece").agg(*sums).withColumn("share", share)
    units = groups.where(F.col("share") <= 1 / shards).select("same", F.lit(0).alias("piece"), *SIZES, "share").unionByName(pieces)
    units = storage.saved(units.withColumn("first", F.col("share") > 1 / (shards * RATIO)) if slices > 1 else units.withColumn("first", F.lit(True)), "units")

    room = np.full((shards, len(SIZES)), 1.0 / shards)
    scale = np.array([total[c] or 1 for c in SIZES], float)

    def placed(some: DataFrame, n: int, last: bool = False) -> DataFrame:
        """The shards of units, in n slices, each with its part of the room; at last what each slice has fills its part."""
        whole = room / np.where((left := room.sum(0)) > 0, left, 1) if last else room / n

        def fill(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["same", "piece"], ascending=False, kind="stable")
            vectors = frame[SIZES].to_numpy(float) / scale
            frame["shard"] = place(vectors, whole * vectors.sum(0) if last else whole, int(frame["slice"].iloc[0]) % shards)
            return frame[["same", "piece", "shard", *SIZES]]

        sliced = some.withColumn("slice", F.pmod(F.xxhash64("same", "piece"), F.lit(n)).cast("int"))
        return storage.saved(sliced.groupBy("slice").applyInPandas(fill, "same binary, piece int, shard int, bytes long, tokens long, rows long"), "placed")

    def left(found: DataFrame) -> np.ndarray:
        """The room without what was placed: a row for each shard comes to the driver."""
        out = room.copy()
        for r in found.groupBy("shard").agg(*(F.sum(c).alias(c) for c in SIZES)).collect():
            out[r["shard"]] -= np.array([r[c] for c in SIZES]) / scale
        return out

    first = placed(units.where("first"), 1)
    room = left(first)
    others, n, most = None, max(1, RATIO // 8), 1 / (shards * RATIO)
    while slices > 1:  # groups of at most ``most``
        last = n >= slices
        least = 0.0 if last else most / RATIO
        level = placed(units.where(~F.col("first") & (F.col("share") <= most) & (F.col("share") > least if not last else F.lit(True))), min(n, slices), last)
        others = level if others is None else others.unionByName(level)
        if last:
            break
        room, n, most = left(level), n * RATIO, least

    located = tagged.join(F.broadcast(first.select("same", "piece", "shard")), ["same", "piece"], "left")
    if others is not None:
        small = located.where("shard is null").drop("shard").join(others.select("same", "piece", "shard"), ["same", "piece"])
        located = located.where("shard is not null").unionByName(small)
    chunk = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(slices)).cast("int")
    located = storage.saved(located.select("doc_id", "size", "text_crc32", "n_tokens", "row", "shard", chunk.alias("chunk")), "located")
    # offsets of a shard's chunks: one row for each chunk and shard
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = located.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "row")
    numbered = located.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["shard", "chunk"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens"
    )
