"""Fields, column mappings, domains of values and settings of the two kinds of entity."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

STRING, LONG = "string", "long"

COMPANY_FIELDS = dict.fromkeys("record_id name domain website linkedin_url phone address city state zip_code country industry".split(), STRING) | {"employee_count": LONG} | dict.fromkeys("owner_id lead_status lifecycle_stage create_date last_modified_date last_activity_date".split(), STRING) | dict.fromkeys("num_associated_contacts num_associated_deals num_form_submissions".split(), LONG) | {"additional_domains": STRING}
CONTACT_FIELDS = dict.fromkeys("record_id email first_name last_name phone linkedin_url company_name job_title company_domain website owner_id lead_status lifecycle_stage create_date last_modified_date last_activity_date".split(), STRING)

# Source column names of CRM exports and APIs, in the order in which later ones win.
COMPANY_COLUMNS = {
    "Record ID": "record_id", "Company name": "name", "Company Domain Name": "domain", "Website URL": "website", "LinkedIn Company Page": "linkedin_url", "Phone Number": "phone",
    "Street Address": "address", "City": "city", "State/Region": "state", "Postal Code": "zip_code", "Country/Region": "country", "Industry": "industry", "Number of Employees": "employee_count",
    "Lifecycle Stage": "lifecycle_stage", "Company owner": "owner_id", "Last Activity Date": "last_activity_date", "Create Date": "create_date", "Number of Associated Contacts": "num_associated_contacts",
    "Number of Associated Deals": "num_associated_deals", "Lead Status": "lead_status", "Number of Form Submissions": "num_form_submissions", "Additional Domains": "additional_domains",
    "hs_object_id": "record_id", "name": "name", "domain": "domain", "website": "website", "linkedin_company_page": "linkedin_url", "hs_linkedin_handle": "linkedin_url", "phone": "phone",
    "address": "address", "city": "city", "state": "state", "zip": "zip_code", "country": "country", "industry": "industry", "numberofemployees": "employee_count", "lifecyclestage": "lifecycle_stage",
    "hubspot_owner_id": "owner_id", "notes_last_updated": "last_activity_date", "hs_lastmodifieddate": "last_modified_date", "createdate": "create_date", "num_associated_contacts": "num_associated_contacts",
    "num_associated_deals": "num_associated_deals", "hs_lead_status": "lead_status", "hs_additional_domains": "additional_domains",
    "Id": "record_id", "Name": "name", "Website": "website", "Phone": "phone", "BillingStreet": "address", "BillingCity": "city", "BillingState": "state", "BillingPostalCode": "zip_code",
    "BillingCountry": "country", "NumberOfEmployees": "employee_count", "OwnerId": "owner_id",
}
CONTACT_JSON_COLUMNS = {
    "firstname": "first_name", "lastname": "last_name", "email": "email", "phone": "phone", "hs_linkedin_url": "linkedin_url", "company": "company_name", "jobtitle": "job_title",
    "hubspot_owner_id": "owner_id", "hs_lead_status": "lead_status", "lifecyclestage": "lifecycle_stage", "createdate": "create_date", "lastmodifieddate": "last_modified_date",
    "lastactivitydate": "last_activity_date", "hs_object_id": "record_id", "website": "website",
}
CONTACT_COLUMNS = CONTACT_JSON_COLUMNS | {
    "company_website": "website", "First Name": "first_name", "Last Name": "last_name", "Record ID": "record_id", "Email": "email", "Phone Number": "phone", "LinkedIn URL": "linkedin_url",
    "Company Name": "company_name", "Associated Company (Primary)": "company_name", "Job Title": "job_title", "Contact owner": "owner_id", "Lead Status": "lead_status", "Lifecycle Stage": "lifecycle_stage",
    "Create Date": "create_date", "Last Modified Date": "last_modified_date", "Last Activity Date": "last_activity_date", "Website URL": "website", "FirstName": "first_name", "LastName": "last_name",
    "Id": "record_id", "Phone": "phone", "LinkedIn__c": "linkedin_url", "Company": "company_name", "Title": "job_title", "OwnerId": "owner_id", "LeadStatus": "lead_status", "Website": "website",
}
# What a CSV reader takes for missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# What search requests ask for.
OBJECT_COLUMNS = {
    "contacts": ["email", "firstname", "lastname", "company", "createdate", "lifecyclestage", "notes_last_updated"],
    "companies": ["name", "domain", "createdate", "industry", "numberofemployees"],
    "deals": ["dealname", "amount", "dealstage", "closedate", "pipeline", "createdate"],
    "tickets": ["subject", "content", "hs_pipeline_stage", "createdate", "hubspot_owner_id"],
}

# Types of matches and what is recommended for each.
MATCH_TYPES = ("deterministic_high", "deterministic_medium", "probabilistic_high", "probabilistic_medium")
ACTIONS = {"deterministic_high": "auto_merge", "deterministic_medium": "review_merge", "probabilistic_high": "review_merge", "probabilistic_medium": "manual_review"}


# The weights here and the thresholds and caps below.
def _company_weights() -> dict[str, float]:
    return {"name": 0.45, "location": 0.25, "industry": 0.15, "phone": 0.10, "employee_count": 0.05}


def _contact_weights() -> dict[str, float]:
    return {"name": 0.55, "company": 0.25, "title": 0.15, "domain": 0.05}


@dataclass(frozen=True)
class Settings:
    """Thresholds of probabilistic matching. Weights must name every part."""

    similarity_weights: dict[str, float]
    probabilistic_high_threshold: float
    probabilistic_medium_threshold: float
    min_name_similarity: float
    sparse_min_name_similarity: float
    min_matching_dimensions: int
    use_blocking: bool
    blocking_min_candidates: int
    block_cap: int | None
    cross_domain_min_name_similarity: float = 0.95
    parts: tuple[str, ...] = field(default=(), repr=False)

    def __post_init__(self) -> None:
        if set(self.similarity_weights) != set(self.parts):
            raise ValueError(f"similarity_weights must have exactly: {', '.join(self.parts)}")

    def replaced(self, **changes) -> Settings:
        return replace(self, **changes)


def company_settings(**changes) -> Settings:
    base = dict(similarity_weights=_company_weights(), probabilistic_high_threshold=0.82, probabilistic_medium_threshold=0.72, min_name_similarity=0.85, sparse_min_name_similarity=0.92, min_matching_dimensions=2, use_blocking=True, blocking_min_candidates=30, block_cap=150, parts=tuple(_company_weights()))
    return Settings(**base | changes)


def contact_settings(**changes) -> Settings:
    base = dict(similarity_weights=_contact_weights(), probabilistic_high_threshold=0.82, probabilistic_medium_threshold=0.68, min_name_similarity=0.80, sparse_min_name_similarity=0.90, min_matching_dimensions=1, use_blocking=True, blocking_min_candidates=50, block_cap=100, parts=tuple(_contact_weights()))
    return Settings(**base | changes)
