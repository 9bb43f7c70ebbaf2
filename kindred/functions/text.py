"""Normalization of names, addresses of the web, phones and places, as Column functions.

Empty strings count as missing. White space, letters and word boundaries are Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Legal forms and sector words that company names lose.
COMPANY_SUFFIXES = (
    "inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|lp|llp|gmbh|ag|sa|sarl|srl|bv|nv|pty|pvt|"
    "group|holdings|international|intl|associates|partners|hospital|medical center|health system|healthcare|health"
)
# Second-level suffixes of countries.
COUNTRY_SUFFIXES = ("co.uk", "com.au", "co.nz", "co.za", "com.br", "co.in", "co.jp")
# Ends of e-mail domains that are not a company's.
PERSONAL_DOMAINS = (".gmail.com", ".outlook.com", ".yahoo.com", ".hotmail.com", ".aol.com", ".icloud.com", ".me.com", ".live.com", ".msn.com", ".protonmail.com", ".mail.com")
# States and provinces by abbreviation.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii",
    "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan",
    "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District Of Columbia",
    "ON": "Ontario", "QC": "Quebec", "BC": "British Columbia", "AB": "Alberta",
}


def missing(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def title(x: Column) -> Column:
    """Upper case for each letter after a character that is none, lower case for the others."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def norm_email(x: Column) -> Column:
    return missing(strip(F.lower(x)))


def norm_person_name(x: Column) -> Column:
    return missing(title(strip(F.regexp_replace(x, r"(?U)[^\w\s]", ""))))


def norm_company_name(x: Column) -> Column:
    x = strip(missing(x))
    short = strip(F.regexp_replace(F.regexp_replace(x, rf"(?iU)\b({COMPANY_SUFFIXES})\b\.?", ""), r"(?U)\s+", " "))
    return missing(F.when(F.length(short) < 2, x).otherwise(short))


def url_netloc(x: Column) -> Column:
    """Host with port and user of a URL, without a leading www."""
    x = strip(F.lower(missing(x)))
    full = F.when(x.rlike(r"^[a-z0-9+.-]+://"), x).otherwise(F.concat(F.lit("https://"), x))
    host = F.regexp_replace(F.regexp_extract(full, r"^[a-z0-9+.-]+://([^/?#]*)", 1), r"^www\.", "")
    return F.when(F.contains(host, F.lit(".")), host)


def norm_domain(x: Column) -> Column:
    x = strip(F.lower(missing(x)))
    host = F.when(F.contains(x, F.lit("://")), F.coalesce(url_netloc(x), x)).otherwise(x)
    host = strip(F.get(F.split(F.regexp_replace(host, r"^www\.", ""), "/"), F.lit(0)))
    return F.when(F.contains(host, F.lit(".")), host)


def root_domain(x: Column) -> Column:
    parts = F.split(missing(x), r"\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    long = last(2).isin(*COUNTRY_SUFFIXES) & (F.size(parts) >= 3)
    return F.when(F.size(parts) >= 2, F.when(long, F.when(F.size(parts) >= 3, last(3))).otherwise(last(2)))


def norm_linkedin_company(x: Column) -> Column:
    x = strip(F.lower(missing(x)))
    company, school = (F.regexp_extract(x, rf"linkedin\.com/({kind}/[^/?#]+)", 1) for kind in ("company", "school"))
    slug = F.coalesce(missing(company), missing(school))
    return missing(F.coalesce(F.concat(F.lit("linkedin.com/"), slug), x))


def norm_linkedin_person(x: Column) -> Column:
    x = F.lower(missing(x))
    slug = missing(F.regexp_extract(x, r"linkedin\.com/in/([^/?]+)", 1))
    return missing(F.coalesce(F.concat(F.lit("linkedin.com/in/"), slug), strip(x)))


def norm_phone(x: Column) -> Column:
    digits = F.regexp_replace(missing(x), r"[^0-9]", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) >= 7, digits)


def norm_state(x: Column) -> Column:
    x = strip(missing(x))
    names = F.create_map(*(F.lit(v) for pair in STATES.items() for v in pair))
    return missing(F.coalesce(F.try_element_at(names, F.upper(x)), title(x)))


def norm_place(x: Column) -> Column:
    return missing(title(strip(missing(x))))


def split_additional_domains(x: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"(?U)[;,\s]+"), lambda d: strip(F.lower(d)))
    return F.filter(parts, lambda d: F.contains(d, F.lit(".")))


def all_domains(primary: Column, website: Column, additional: Column) -> Column:
    """Distinct domains of a company whose primary domain is normalized already."""
    own = url_netloc(website)
    backup = F.when(own != primary, norm_domain(own))
    found = F.concat(F.array(primary, backup), F.transform(split_additional_domains(additional), norm_domain))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))


def email_domain(x: Column) -> Column:
    return F.coalesce(F.get(F.split(x, "@"), F.lit(1)), F.lit(""))


def company_domain_derive(website: Column, email: Column, strict: bool = False) -> Column:
    """A contact's company domain: that of the website, or else the e-mail's. Personal domains
    are told by their end with its dot, so that they pass themselves unless strict."""
    domain = missing(email_domain(email))
    personal = reduce(lambda a, b: a | b, (domain.endswith(d) for d in PERSONAL_DOMAINS))
    if strict:
        personal |= domain.isin(*(d[1:] for d in PERSONAL_DOMAINS))
    return F.coalesce(url_netloc(website), F.when(~personal, domain))


def full_name(first: Column, last: Column) -> Column:
    return strip(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def block_key_company(name: Column) -> Column:
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    return F.when(F.length(letters) >= 3, F.substring(letters, 1, 4))


def block_key_contact(first: Column, last: Column) -> Column:
    a, b = missing(strip(F.lower(F.coalesce(first, F.lit(""))))), missing(strip(F.lower(last)))
    return F.when(a.isNotNull(), F.concat(b, F.lit("_"), F.substring(a, 1, 1))).otherwise(b)


def first_word(name: Column) -> Column:
    return F.regexp_replace(F.get(F.split(strip(F.lower(name)), r"(?U)\s+"), F.lit(0)), "[^a-z]", "")


def generate_id(*keys: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 12)


def null_placeholder(x: Column) -> Column:
    return F.coalesce(missing(x.cast("string")), F.lit("—"))


def csv_escape(x: Column) -> Column:
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
