"""Clusters of batches as they come, with the results of a whole run over all rows so far.

Kept between batches, as tables in the shared folder: entities, the index (rule, key,
id) of all keys, the similar pairs of each name block, which its cap bounds, and component labels: all of
them grow with the records. A batch of rows touches the keys of its records and of the records
that it replaces (of rows with one id the last stays). Only name blocks that it touches are compared
again, over the records that have them, as the first of a block by id count; what they gave before is replaced.
Records that have a touched key, and the components that these were in, are contracted again from links of
their keys, not of pairs; the other components keep their labels.

Matches are not kept, as they grow with the square of a key's records: they are a plan over what is kept, as in a
whole run, and are found where they are read.

Rows of a batch may not share a record with a later batch's unless that replaces it. Each batch
writes its tables anew, without shuffling what is kept but for the parts that its keys or
nodes touch, and deletes those before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from .. import storage
from ..functions import text as t
from ..operators import entities, matching as m
from ..operators.links import match_components
from ..schema import Settings, company_settings, contact_settings
from . import pipeline

BLOCK = 0


def keys_of(kind: str, rows: DataFrame) -> DataFrame:
    """rule (its rank; 0: the name block), key and id of the keys by which records meet."""
    domains = rows.select("record_id", F.explode("all_domains").alias("domain")) if kind == "company" else None
    if kind == "company":
        slug = F.element_at(F.split("linkedin_url", "/"), -1)
        found = [
            domains.select(F.lit(1).alias("rule"), F.col("domain").alias("key"), "record_id"), domains.select(F.lit(2), t.root_domain(F.col("domain")), "record_id"),
            rows.where(F.length(slug) >= 10).select(F.lit(3), "linkedin_url", "record_id"), rows.select(F.lit(4), "phone", "record_id"),
        ]
    else:
        found = [rows.select(F.lit(1).alias("rule"), F.col("email").alias("key"), "record_id"), rows.select(F.lit(2), "linkedin_url", "record_id"), rows.select(F.lit(3), F.concat("block_key", F.lit(" @ "), "company_domain"), "record_id")]
    out = rows.select(F.lit(BLOCK), "block_key", "record_id")
    for f in reversed(found):
        out = f.union(out)
    return out.where("key is not null").distinct().withColumnRenamed("record_id", "id")


@dataclass
class State:
    """What is kept after a batch. ``blocks`` has the similar pairs of name blocks, whether a rule matches them or not."""

    kind: str
    settings: Settings
    entities: DataFrame
    index: DataFrame
    blocks: DataFrame
    labels: DataFrame

    def result(self) -> pipeline.Result:
        found = pipeline.Result(self.kind, self.entities, self.settings, self.blocks.drop("key"))
        found.labels = self.labels
        return found

    @cached_property
    def matches(self) -> DataFrame:
        return self.result().matches


KEPT = ("entities", "index", "blocks", "labels")


def without(df: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    return df.join(other.select(*columns).distinct(), list(columns), "left_anti")


def within(df: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    return df.join(other.select(*columns).distinct(), list(columns), "left_semi")


def start(kind: str, rows: DataFrame, as_of: str, settings: Settings | None = None) -> State:
    """The state after the first batch."""
    settings = settings or (company_settings() if kind == "company" else contact_settings())
    if not settings.use_blocking:
        raise ValueError("batches need name blocks: without them each batch would be compared with all records")
    new = normalized(kind, rows, as_of)
    spark = rows.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    kept = {"entities": new.limit(0), "index": empty("rule int, key string, id string"), "blocks": None, "labels": empty("node string, component string")}
    return advance(State(kind, settings, **kept), new)


def add(state: State, rows: DataFrame, as_of: str) -> State:
    """The state after one more batch; the tables of the given one are deleted."""
    before = [getattr(state, x) for x in KEPT]
    after = advance(state, normalized(state.kind, rows, as_of))
    storage.discard(*before)
    return after


def normalized(kind: str, rows: DataFrame, as_of: str) -> DataFrame:
    normal = entities.normalize_company(rows) if kind == "company" else entities.normalize_contact(rows)
    return storage.saved(entities.with_survivor_score(normal, kind, as_of), "batch")


def advance(state: State, new: DataFrame) -> State:
    kind, settings = state.kind, state.settings
    ids = new.select("record_id")
    every = storage.saved(without(state.entities, ids, "record_id").unionByName(new), "entities")
    fresh = keys_of(kind, new)
    gone = within(state.index, ids.withColumnRenamed("record_id", "id"), "id")
    touched = storage.saved(fresh.select("rule", "key").union(gone.select("rule", "key")).distinct(), "touched")
    index = storage.saved(without(state.index, ids.withColumnRenamed("record_id", "id"), "id").unionByName(fresh), "index")

    # the records that have a touched key, and what touched blocks give now
    meeting = storage.saved(within(index, touched, "rule", "key"), "meeting")
    block = lambda df: df.where(F.col("rule") == BLOCK)
    some = within(every, block(meeting).select(F.col("id").alias("record_id")), "record_id").where("block_key is not null")
    pairs = m.candidates_by_name(some, settings.replaced(blocking_min_candidates=0))
    found = (m.probabilistic_company if kind == "company" else m.probabilistic_contact)(some, pairs, settings)
    found = found.join(some.select(F.col("record_id").alias("id1"), F.col("block_key").alias("key")), "id1").select(*found.columns, "key")
    blocks = storage.saved(found if state.blocks is None else without(state.blocks, block(touched), "key").unionByName(found), "blocks")

    # a match of a record in a component that is not touched has both its ends there
    ends = storage.saved(meeting.select(F.col("id").alias("node")).union(ids).distinct(), "ends")
    nodes = storage.saved(within(state.labels, within(state.labels, ends, "node"), "component").select("node").union(ends).distinct(), "nodes")
    inside = lambda df, column: within(df, nodes.withColumnRenamed("node", column), column)
    again = match_components(kind, inside(every, "record_id"), settings, inside(blocks.select("id1", "id2"), "id1"), inside(m.gate_linkedin(every), "id") if kind == "company" else None)
    labels = storage.saved(without(state.labels, nodes, "node").unionByName(again), "labels")
    storage.discard(touched, meeting, new, ends, nodes)
    return State(kind, settings, every, index, blocks, labels)
