"""Normalized entities with quality scores. One row for each record_id: of rows that share
one, the last in input order (``position``, or the greatest row) stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import quality as q, text as t
from ..schema import COMPANY_FIELDS, CONTACT_FIELDS


def with_fields(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """rows with exactly the fields, null where there is no such column, and position and raw_data if there."""
    have = {c.lower(): c for c in rows.columns}
    cols = [F.col(f"`{have[f]}`").cast(k).alias(f) if f in have else F.lit(None).cast(k).alias(f) for f, k in fields.items()]
    cols = [t.missing(c).alias(f) if k == "string" else c for (f, k), c in zip(fields.items(), cols, strict=True)]
    return rows.select(*cols, *(c for c in ("position", "raw_data") if c in rows.columns)).where("record_id is not null")


def last_of_each(rows: DataFrame) -> DataFrame:
    order = [F.desc("position")] if "position" in rows.columns else [F.desc(c) for c in rows.columns if c not in ("record_id", "raw_data")]
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("record_id").orderBy(*order))).where("_nth = 1").drop("_nth")


def normalize_company(rows: DataFrame) -> DataFrame:
    rows = last_of_each(with_fields(rows, COMPANY_FIELDS))
    primary = F.coalesce(t.norm_domain(F.col("domain")), t.url_netloc(F.col("website")))
    rows = rows.withColumn("domain", primary).withColumn("all_domains", t.all_domains(F.col("domain"), F.col("website"), F.col("additional_domains")))
    rows = rows.withColumns({
        "name": t.norm_company_name(F.col("name")), "linkedin_url": t.norm_linkedin_company(F.col("linkedin_url")), "phone": t.norm_phone(F.col("phone")),
        "state": t.norm_state(F.col("state")), "city": t.norm_place(F.col("city")), "country": t.norm_place(F.col("country")),
    })
    engaged = q.engagement(F.col("last_activity_date"), F.col("lead_status"), F.col("lifecycle_stage"), q.COMPANY_LEADS, q.COMPANY_ENGAGED, F.col("num_associated_deals"))
    return scored(rows.withColumn("block_key", t.block_key_company(F.col("name"))), q.COMPANY_KEYS, engaged)


def normalize_contact(rows: DataFrame, strict_personal_domains: bool = False) -> DataFrame:
    rows = last_of_each(with_fields(rows, CONTACT_FIELDS))
    rows = rows.withColumns({
        "email": t.norm_email(F.col("email")), "first_name": t.norm_person_name(F.col("first_name")), "last_name": t.norm_person_name(F.col("last_name")), "linkedin_url": t.norm_linkedin_person(F.col("linkedin_url")),
    })
    rows = rows.withColumn("company_domain", F.coalesce("company_domain", t.company_domain_derive(F.col("website"), F.col("email"), strict_personal_domains)))
    rows = rows.withColumn("name", t.missing(t.full_name(F.col("first_name"), F.col("last_name")))).withColumn("block_key", t.block_key_contact(F.col("first_name"), F.col("last_name")))
    engaged = q.engagement(F.col("last_activity_date"), F.col("lead_status"), F.col("lifecycle_stage"), q.CONTACT_LEADS, q.CONTACT_ENGAGED)
    return scored(rows, q.CONTACT_KEYS, engaged)


def scored(rows: DataFrame, keys: tuple[str, ...], engaged) -> DataFrame:
    rows = rows.withColumn("completeness_score", q.completeness(*map(F.col, keys))).withColumn("engagement_score", engaged)
    return rows.withColumn("data_quality_score", q.data_quality(F.col("completeness_score"), F.col("engagement_score")))


def with_survivor_score(rows: DataFrame, kind: str, as_of: str) -> DataFrame:
    c = F.col
    if kind == "company":
        score = q.survivor_score_company(c("data_quality_score"), c("last_activity_date"), c("lifecycle_stage"), c("num_associated_contacts"), c("owner_id"), c("last_modified_date"), as_of)
    else:
        score = q.survivor_score_contact(c("data_quality_score"), c("last_activity_date"), c("lifecycle_stage"), c("owner_id"), c("last_modified_date"), as_of)
    return rows.withColumn("survivor_score", score)
