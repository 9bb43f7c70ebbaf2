"""The whole run: normalized entities to matches, survivors, clusters and reports."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from .. import storage
from ..functions import text as t
from ..operators import entities, matching as m
from ..operators.links import match_components
from ..schema import MATCH_TYPES, Settings, company_settings, contact_settings


@dataclass
class Result:
    kind: str
    entities: DataFrame
    settings: Settings
    #: What the similar names of the name blocks gave, whether a rule matches it or not, where that is kept.
    probable: DataFrame | None = None
    #: Only matches whose first id is not greater; of all records without it.
    below: str | None = None

    @cached_property
    def matches(self) -> DataFrame:
        return self.matches_with()

    def matches_with(self, *columns: str) -> DataFrame:
        """matches, with these columns of both records as <column>1 and <column>2; no join of all matches brings them."""
        found = find_matches(self.kind, self.entities, self.settings, *dict.fromkeys(("survivor_score", *columns)), probable=self.probable, below=self.below)
        found = found.withColumn("survivor", m.better("survivor_score1", "survivor_score2")).withColumn("action", m.action(F.col("match_type")))
        return found if "survivor_score" in columns else found.drop("survivor_score1", "survivor_score2")

    @cached_property
    def labels(self) -> DataFrame:
        """node and component of the records that have a match, which does not take the matches themselves."""
        return match_components(self.kind, self.entities, self.settings)

    @cached_property
    def clusters(self) -> DataFrame:
        return numbered_clusters(self.labels)


def deterministic(kind: str, rows: DataFrame, *also: str, below: str | None = None) -> DataFrame:
    return m.pairs_by_first_rule(kind, rows, *also, below=below)


def find_matches(kind: str, rows: DataFrame, settings: Settings, *also: str, probable: DataFrame | None = None, below: str | None = None) -> DataFrame:
    """Deterministic matches, then probabilistic ones (``probable``, where they are kept) of the candidates that these left; with the columns ``also`` of both records."""
    found = deterministic(kind, rows, *also, below=below).drop("rule_rank")
    first = lambda pairs: pairs if below is None else pairs.where(F.col("id1") <= below)
    if probable is None:
        left = m.unmatched(kind, first(m.candidates_by_name(rows, settings)), rows)
        more = m.probabilistic_company(rows, left, settings) if kind == "company" else m.probabilistic_contact(rows, left, settings)
    else:
        more = m.unmatched(kind, first(probable), rows)
    return found.unionByName(m.both_sides(more, rows, list(also)) if also else more)


def numbered_clusters(labels: DataFrame) -> DataFrame:
    """cluster_id (cluster_1, ... by smallest member), members (sorted) and size, of components of two or more."""
    groups = labels.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("size")).where("size > 1")
    # the place of a cluster in the order of smallest members: a range sort, then counts of the partitions before
    numbered = storage.numbered(groups, "component")
    return numbered.select(F.concat(F.lit("cluster_"), F.col("nth").cast("string")).alias("cluster_id"), "members", "size")


def deduplicate(rows: DataFrame, kind: str, as_of: str, settings: Settings | None = None) -> Result:
    """The run over raw canonical rows of companies or contacts: matches and clusters are found where they are
    asked for. Matches are a plan over the saved entities, as writing them would take room for all pairs."""
    settings = settings or (company_settings() if kind == "company" else contact_settings())
    normal = entities.normalize_company(rows) if kind == "company" else entities.normalize_contact(rows)
    normal = storage.saved(entities.with_survivor_score(normal, kind, as_of), "entities")
    return Result(kind, normal, settings)


def cluster_survivor(result: Result) -> DataFrame:
    """For each cluster the member with the best survivor score; the smallest id wins ties."""
    members = result.clusters.select("cluster_id", F.explode("members").alias("record_id")).join(result.entities.select("record_id", "survivor_score"), "record_id")
    best = members.groupBy("cluster_id").agg(F.max("survivor_score").alias("survivor_score"))
    return members.join(best, ["cluster_id", "survivor_score"]).groupBy("cluster_id", "survivor_score").agg(F.min("record_id").alias("survivor"))


def match_breakdown(matches: DataFrame) -> DataFrame:
    """Number of matches of each type, zeros too."""
    domain = matches.sparkSession.createDataFrame([(k,) for k in MATCH_TYPES], "match_type string")
    return domain.join(matches.groupBy("match_type").count(), "match_type", "left").select("match_type", F.coalesce("count", F.lit(0)).alias("n_matches"))


def summary(result: Result) -> DataFrame:
    """One row: entities, matches, clusters, duplicates to remove and their rate in percent."""
    n = result.entities.agg(F.count("*").alias("total_entities"))
    k = result.matches.agg(F.count("*").alias("total_matches"))
    c = result.clusters.agg(F.count("*").alias("total_clusters"), (F.coalesce(F.sum("size"), F.lit(0)) - F.count("*")).alias("duplicates_to_remove"))
    rate = F.when(F.col("total_entities") > 0, F.col("duplicates_to_remove") / F.col("total_entities") * 100).otherwise(0.0)
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(n).join(one(k), "_one").join(one(c), "_one").drop("_one").withColumn("deduplication_rate", rate)


SIDES = {
    "company": {"name": "name", "domain": "domain", "phone": "phone", "city": "city", "state": "state", "industry": "industry"},
    "contact": {"name": "name", "email": "email", "company": "company_name", "phone": "phone", "title": "job_title"},
}
CSV_SIDES = {"company": {"Name": "name", "Domain": "domain", "City": "city"}, "contact": {"Name": "name", "Email": "email", "Company": "company_name"}}
ENTITY = {
    "company": {"id": "record_id", "name": "name", "domain": "domain", "website": "website", "phone": "phone", "linkedin_url": "linkedin_url", "city": "city", "state": "state", "country": "country", "industry": "industry", "employee_count": "employee_count", "lifecycle_stage": "lifecycle_stage", "last_activity_date": "last_activity_date", "last_modified_date": "last_modified_date", "owner_id": "owner_id"},
    "contact": {"id": "record_id", "name": "name", "email": "email", "company": "company_name", "phone": "phone", "title": "job_title", "lifecycle_stage": "lifecycle_stage", "last_activity_date": "last_activity_date", "last_modified_date": "last_modified_date", "owner_id": "owner_id"},
}


def lookup_entity(result: Result, *columns: str) -> DataFrame:
    """matches with columns of both records as <column>_1 and <column>_2: these, or all, which takes joins of all matches."""
    if not columns:
        side = lambda n: result.entities.select(F.col("record_id").alias(f"id{n}"), *(F.col(c).alias(f"{c}_{n}") for c in result.entities.columns))
        return result.matches.join(side(1), "id1").join(side(2), "id2")
    found = result.matches_with(*columns)
    return found.select(*(c for c in found.columns if c not in {f"{x}{n}" for x in columns for n in (1, 2)}), *(F.col(f"{c}{n}").alias(f"{c}_{n}") for n in (1, 2) for c in columns))


def matches_table(result: Result) -> DataFrame:
    """The flat table of matches, with 14 columns."""
    kind = result.kind.capitalize()
    sides = [x for n in (1, 2) for x in (F.col(f"id{n}").alias(f"{kind}_{n}_ID"), *(F.coalesce(f"{c}_{n}", F.lit("")).alias(f"{kind}_{n}_{name}") for name, c in CSV_SIDES[result.kind].items()))]
    return lookup_entity(result, *CSV_SIDES[result.kind].values()).select(
        *sides, F.col("match_type").alias("Match_Type"), F.round("confidence_score", 3).alias("Confidence_Score"), F.array_join("matching_fields", ", ").alias("Matching_Fields"),
        F.col("explanation").alias("Explanation"), F.col("survivor").alias("Survivor_Recommendation"), F.col("action").alias("Recommended_Action"),
    )


def enriched_matches(result: Result) -> DataFrame:
    kind = result.kind
    sides = [t.null_placeholder(F.col(f"{c}_{n}")).alias(f"{kind}_{n}_{name}") for n in (1, 2) for name, c in SIDES[kind].items()]
    return lookup_entity(result, *SIDES[kind].values()).select(
        F.col("id1").alias(f"{kind}_1_id"), F.col("id2").alias(f"{kind}_2_id"), "match_type", F.round("confidence_score", 3).alias("confidence_score"), "matching_fields", "explanation",
        F.col("survivor").alias("survivor_recommendation"), F.col("action").alias("recommended_action"), *sides,
    )


def entity_dictionary(result: Result) -> DataFrame:
    """The records that are in clusters, as reports show them."""
    inside = result.clusters.select(F.explode("members").alias("record_id")).distinct()
    rows = result.entities.join(inside, "record_id", "left_semi")
    shown = [t.null_placeholder(F.col(c)).alias(n) for n, c in ENTITY[result.kind].items()]
    if result.kind == "company":
        shown += [F.coalesce(c, F.lit(0)).alias(c) for c in ("num_associated_contacts", "num_associated_deals")]
        shown.append(F.when(F.col("domain").isNotNull(), F.array_except("all_domains", F.array("domain"))).otherwise(F.col("all_domains")).alias("additional_domains"))
    return rows.select(*shown, F.round("survivor_score", 4).alias("survivor_score"), F.round("data_quality_score", 4).alias("data_quality_score"))


def sample_matches(result: Result, n: int = 10) -> DataFrame:
    """The first ``n`` matches by their ids, found from the records with the smallest ids; from more of them, and at
    last from all, where these have fewer matches."""
    kind = result.kind.capitalize()
    order = [f"{kind}_1_ID", f"{kind}_2_ID"]
    for first in (10 * n, 1000 * n):
        below = result.entities.select("record_id").orderBy("record_id").limit(first).agg(F.max("record_id")).first()[0]
        some = storage.saved(matches_table(replace(result, below=below)).orderBy(*order).limit(n), "sample")
        if some.count() == n:
            return some.orderBy(*order)
    return matches_table(result).orderBy(*order).limit(n)
