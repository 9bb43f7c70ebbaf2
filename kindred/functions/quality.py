"""Quality of a record and its fitness as the survivor of a merge, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import missing, strip

COMPANY_KEYS = ("name", "domain", "phone", "city", "state", "industry", "linkedin_url")
CONTACT_KEYS = ("email", "first_name", "last_name", "company_name", "job_title", "linkedin_url")
# States of leads and stages that count as engagement, and the worth of stages.
COMPANY_LEADS = ("CONNECTED", "OPEN_DEAL", "IN_PROGRESS", "OPEN", "IN PROGRESS")
CONTACT_LEADS = ("CONNECTED", "OPEN_DEAL", "IN_PROGRESS")
COMPANY_ENGAGED = ("CUSTOMER", "OPPORTUNITY", "SALES ACCEPTED LEAD", "SALESQUALIFIEDLEAD", "SALES QUALIFIED LEAD")
CONTACT_ENGAGED = ("CUSTOMER", "OPPORTUNITY", "SQL")
COMPANY_STAGES = {"CUSTOMER": 1.0, "OPPORTUNITY": 0.9, "SALES ACCEPTED LEAD": 0.85, "SALESQUALIFIEDLEAD": 0.8, "SALES QUALIFIED LEAD": 0.8, "MARKETING QUALIFIED LEAD": 0.7, "MARKETINGQUALIFIEDLEAD": 0.7, "LEAD": 0.5, "CONTACT": 0.3, "SUBSCRIBER": 0.2}
CONTACT_STAGES = {"CUSTOMER": 1.0, "OPPORTUNITY": 0.9, "SQL": 0.8, "MQL": 0.7, "LEAD": 0.5, "SUBSCRIBER": 0.3}


def completeness(*fields: Column) -> Column:
    filled = sum((F.when(missing(strip(f)).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return filled / len(fields)


def engagement(last_activity: Column, lead: Column, stage: Column, leads: tuple[str, ...], stages: tuple[str, ...], deals: Column | None = None) -> Column:
    any_of = missing(last_activity).isNotNull() | F.coalesce(F.upper(lead).isin(*leads), F.lit(False)) | F.coalesce(F.upper(stage).isin(*stages), F.lit(False))
    if deals is not None:
        any_of |= F.coalesce(deals > 0, F.lit(False))
    return F.when(any_of, 1.0).otherwise(0.0)


def data_quality(completeness: Column, engagement: Column) -> Column:
    return completeness * 0.7 + engagement * 0.3


def recency(date: Column, as_of: str) -> Column:
    """1 for today, 0.1 from 360 days ago, 0 for no date, 0.1 for one that cannot be read."""
    date = missing(date)
    seconds = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.try_to_timestamp(date))
    days = F.floor(seconds / 86400)
    return F.when(date.isNull(), 0.0).otherwise(F.coalesce(F.greatest(F.lit(0.1), 1 - days / 400), F.lit(0.1)))


def stage_score(stage: Column, scores: dict[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in scores.items() for x in pair))
    return F.when(missing(stage).isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(table, F.upper(stage)), F.lit(0.1)))


def owned(owner: Column, stripped: bool) -> Column:
    owner = missing(strip(owner) if stripped else owner)
    return F.when(owner.isNotNull() & (owner != "unassigned"), 1.0).otherwise(0.0)


def survivor_score_company(quality: Column, activity: Column, stage: Column, contacts: Column, owner: Column, modified: Column, as_of: str) -> Column:
    many = F.greatest(F.lit(0.0), F.least(F.coalesce(contacts, F.lit(0)) / 20, F.lit(1.0)))
    return quality * 0.25 + recency(activity, as_of) * 0.25 + stage_score(stage, COMPANY_STAGES) * 0.15 + many * 0.15 + owned(owner, True) * 0.10 + recency(modified, as_of) * 0.10


def survivor_score_contact(quality: Column, activity: Column, stage: Column, owner: Column, modified: Column, as_of: str) -> Column:
    return quality * 0.30 + recency(activity, as_of) * 0.30 + stage_score(stage, CONTACT_STAGES) * 0.20 + owned(owner, False) * 0.10 + recency(modified, as_of) * 0.10
