"""DuckDB SQL of the functions and stages, built from expressions. Numbers in texts round half up."""

from __future__ import annotations

from ..functions import quality as q, text as t
from ..operators import matching as m
from . import fixtures


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def inlist(xs) -> str:
    return "(" + ", ".join(map(lit, xs)) + ")"


def missing(x: str) -> str:
    return f"nullif({x}, '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda v: upper(v[1]) || lower(v[2:])), '')"


def netloc(x: str) -> str:
    x = strip(f"lower({missing(x)})")
    full = f"case when regexp_matches({x}, '^[a-z0-9+.-]+://') then {x} else 'https://' || {x} end"
    host = f"regexp_replace(regexp_extract({full}, '^[a-z0-9+.-]+://([^/?#]*)', 1), '^www\\.', '')"
    return f"(case when contains({host}, '.') then {host} end)"


def norm_domain(x: str) -> str:
    s = strip(f"lower({missing(x)})")
    host = f"case when contains({s}, '://') then coalesce({netloc(x)}, {s}) else {s} end"
    host = strip(f"split_part(regexp_replace({host}, '^www\\.', ''), '/', 1)")
    return f"(case when contains({host}, '.') then {host} end)"


def root_domain(x: str) -> str:
    p = f"string_split({missing(x)}, '.')"
    last = lambda n: f"array_to_string({p}[-{n}:], '.')"
    return f"(case when len({p}) >= 3 and {last(2)} in {inlist(t.COUNTRY_SUFFIXES)} then {last(3)} when len({p}) >= 2 then {last(2)} end)"


def norm_phone(x: str) -> str:
    d = f"regexp_replace({missing(x)}, '[^0-9]', '', 'g')"
    d = f"case when length({d}) = 11 and {d}[1] = '1' then {d}[2:] else {d} end"
    return f"(case when length({d}) >= 7 then {d} end)"


def norm_state(x: str) -> str:
    s = strip(missing(x))
    cases = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in t.STATES.items())
    return missing(f"case upper({s}) {cases} else {title(s)} end")


def norm_company_name(x: str) -> str:
    x = strip(missing(x))
    short = strip(f"regexp_replace(regexp_replace({x}, '(?i)\\b({t.COMPANY_SUFFIXES})\\b\\.?', '', 'g'), '\\s+', ' ', 'g')")
    return missing(f"case when length({short}) < 2 then {x} else {short} end")


def linkedin_company(x: str) -> str:
    x = strip(f"lower({missing(x)})")
    e = lambda k: f"nullif(regexp_extract({x}, 'linkedin\\.com/({k}/[^/?#]+)', 1), '')"
    return missing(f"coalesce('linkedin.com/' || coalesce({e('company')}, {e('school')}), {x})")


def linkedin_person(x: str) -> str:
    x = f"lower({missing(x)})"
    return missing(f"coalesce('linkedin.com/in/' || nullif(regexp_extract({x}, 'linkedin\\.com/in/([^/?]+)', 1), ''), {strip(x)})")


def person_name(x: str) -> str:
    return missing(title(strip(f"regexp_replace({x}, '[^\\w\\s]', '', 'g')")))


def place(x: str) -> str:
    return missing(title(strip(missing(x))))


def additional(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[;,\\s]+'), lambda d: lower(d)), lambda d: contains(d, '.'))"


def email_domain(x: str) -> str:
    return f"coalesce(case when contains({x}, '@') then split_part({x}, '@', 2) end, '')"


def derived_domain(website: str | None, email: str) -> str:
    d = missing(email_domain(email))
    personal = " or ".join(f"ends_with({d}, {lit(p)})" for p in t.PERSONAL_DOMAINS)
    mail = f"case when not ({personal}) then {d} end"
    return f"coalesce({netloc(website)}, {mail})" if website else f"({mail})"


def block_company(x: str) -> str:
    s = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    return f"(case when length({s}) >= 3 then {s}[1:4] end)"


def first_word(x: str) -> str:
    return f"regexp_replace(regexp_split_to_array({strip(f'lower({x})')}, '\\s+')[1], '[^a-z]', '', 'g')"


def recency(x: str) -> str:
    at = f"try_cast({x} as timestamp)"
    days = f"floor((epoch(timestamp '2024-02-01 00:00:00') - epoch({at})) / 86400)"
    return f"(case when {x} is null then 0.0 else coalesce(greatest(0.1::double, 1 - {days}::double / 400), 0.1) end)"


def stages(x: str, scores: dict[str, float]) -> str:
    return f"(case when {x} is null then 0.0 else (case upper({x}) " + " ".join(f"when {lit(k)} then {v}::double" for k, v in scores.items()) + " else 0.1::double end) end)"


def completeness(fields) -> str:
    return "((" + " + ".join(f"(case when {missing(strip(f))} is not null then 1 else 0 end)" for f in fields) + f")::double / {len(fields)})"


def jw(name: str, source: str) -> str:
    """CTEs that give (a, b, s) as ``name`` for the pairs of ``source`` (a, b)."""
    n = name
    return f"""
{n}_t as (select distinct a, b from ({source}) where a <> '' and b <> ''),
{n}_p as (select a, b, lower(a) x, lower(b) y, length(a) n, length(b) m, greatest(0, greatest(length(a), length(b)) // 2 - 1) w from {n}_t),
{n}_g as (select *, list_reduce(range(1, n + 1), lambda s, i: list_append(s, coalesce(list_min(list_filter(range(greatest(1, i - w), least(i + w, m) + 1), lambda j: y[j] = x[i] and not list_contains(s, j))), 0)), []::bigint[]) mj from {n}_p),
{n}_h as (select *, list_filter(mj, lambda v: v > 0) mm from {n}_g),
{n}_k as (select *, len(mm) k, len(list_filter(range(1, len(mm) + 1), lambda q: y[mm[q]] <> y[list_sort(mm)[q]])) tt,
 case when x[1] <> y[1] then 0 when n < 2 or m < 2 or x[2] <> y[2] then 1 when n < 3 or m < 3 or x[3] <> y[3] then 2 when n < 4 or m < 4 or x[4] <> y[4] then 3 else 4 end pl from {n}_h),
{n}_j as (select *, case when k = 0 then 0::double else (k::double / n + k::double / m + (k - tt / 2.0::double) / k) / 3 end jr from {n}_k),
{n} as (select a, b, case when a = b then 1.0::double when k = 0 then 0.0::double else jr + 0.1::double * pl * (1 - jr) end s from {n}_j)"""


def percent(x: str) -> str:
    return f"format('{{:.0f}}%', round({x} * 100))"


FX = ",\n".join(f"{name} as ({sql})" for name, (sql, _) in fixtures.ALL.items())

CO = f"""co0 as (select record_id, {missing(norm_company_name('name'))} as name, coalesce({norm_domain('domain')}, {netloc('website')}) as domain, {netloc('website')} as own, website,
 {additional('additional_domains')} as extra, {linkedin_company('linkedin_url')} as linkedin_url, {norm_phone('phone')} as phone, {norm_state('state')} as state, {place('city')} as city, {place('country')} as country,
 nullif(industry, '') as industry, employee_count, lifecycle_stage, lead_status, owner_id, last_activity_date, last_modified_date, num_associated_contacts, num_associated_deals from fx_companies),
co1 as (select *, list_sort(list_distinct(list_filter(list_concat([domain, case when own <> domain then {norm_domain('own')} end], list_transform(extra, lambda d: {norm_domain('d')})), lambda d: d is not null))) as all_domains,
 {block_company('name')} as block_key, {completeness(q.COMPANY_KEYS)} as completeness_score,
 case when last_activity_date is not null or upper(lead_status) in {inlist(q.COMPANY_LEADS)} or upper(lifecycle_stage) in {inlist(q.COMPANY_ENGAGED)} or num_associated_deals > 0 then 1.0::double else 0.0::double end as engagement_score from co0),
co2 as (select *, completeness_score * 0.7::double + engagement_score * 0.3::double as data_quality_score from co1),
co as (select *, data_quality_score * 0.25::double + {recency('last_activity_date')} * 0.25::double + {stages('lifecycle_stage', q.COMPANY_STAGES)} * 0.15::double + greatest(0::double, least(coalesce(num_associated_contacts, 0)::double / 20, 1::double)) * 0.15::double
 + (case when {missing(strip('owner_id'))} <> 'unassigned' then 1.0::double else 0.0::double end) * 0.10::double + {recency('last_modified_date')} * 0.10::double as survivor_score from co2)"""

COD = """dom as (select unnest(all_domains) as key, record_id as id from co),
r1 as (select a.id id1, b.id id2, a.key, 1 rule_rank, 'deterministic_high' match_type, 0.97::double conf, 'domain' fields, 'Shared domain: ' || a.key explanation from dom a join dom b on a.key = b.key and a.id < b.id),
""" + f"""rt as (select distinct {root_domain('key')} as key, id, name from dom join co on id = record_id where name is not null),
rtp as (select a.id id1, b.id id2, a.key, a.name n1, b.name n2 from rt a join rt b on a.key = b.key and a.id < b.id where a.key not in {inlist(m.GENERIC_ROOTS)} and length(a.key) >= 5),
php as (select a.record_id id1, b.record_id id2, a.phone as key, a.name n1, b.name n2 from co a join co b on a.phone = b.phone and a.record_id < b.record_id),
{jw('jd', 'select n1 a, n2 b from rtp union select n1, n2 from php')},
r2 as (select id1, id2, key, 2 rule_rank, 'deterministic_high' match_type, 0.93::double conf, 'root_domain, name' fields, 'Same root domain ''' || key || ''' + similar name (' || {percent('s')} || ')' explanation from rtp join jd on n1 = a and n2 = b where s >= 0.75),
lk as (select linkedin_url as key, record_id as id from co where linkedin_url is not null and length(string_split(linkedin_url, '/')[-1]) >= 10),
lks as (select key from lk group by key having count(*) between 2 and 4),
r3 as (select a.id id1, b.id id2, a.key, 3 rule_rank, 'deterministic_high' match_type, 0.95::double conf, 'linkedin_url' fields, 'Exact LinkedIn URL match: ' || a.key explanation from lk a join lk b on a.key = b.key and a.id < b.id where a.key in (select key from lks)),
r4 as (select id1, id2, key, 4 rule_rank, 'deterministic_medium' match_type, 0.88::double conf, 'phone, name' fields, 'Same phone ' || key || ' + similar name (' || {percent('s')} || ')' explanation from php join jd on n1 = a and n2 = b where s >= 0.75),
det as (select * exclude (rn) from (select *, row_number() over (partition by id1, id2 order by rule_rank, key) rn from (select * from r1 union all select * from r2 union all select * from r3 union all select * from r4)) where rn = 1)"""

COP = f"""bc as (select record_id id, block_key as key, name from (select *, row_number() over (partition by block_key order by record_id) nth from co where block_key is not null) where nth <= 150),
cand as (select a.id id1, b.id id2 from bc a join bc b on a.key = b.key and a.id < b.id),
lft as (select id1, id2 from cand anti join det using (id1, id2)),
sides as (select id1, id2, x.name n1, y.name n2, x.state s1, y.state s2, x.city c1, y.city c2, x.country k1, y.country k2, x.industry i1, y.industry i2, x.phone p1, y.phone p2, x.employee_count e1, y.employee_count e2, x.all_domains d1, y.all_domains d2, x.linkedin_url l1, y.linkedin_url l2
 from lft join co x on id1 = x.record_id join co y on id2 = y.record_id),
{jw('jp', 'select n1 a, n2 b from sides union select lower(c1), lower(c2) from sides union select lower(i1), lower(i2) from sides')},
nm as (select sides.*, coalesce(jn.s, 0) name_sim, coalesce(jc.s, 0) city_sim, coalesce(ji.s, 0) industry_sim from sides left join jp jn on n1 = jn.a and n2 = jn.b left join jp jc on lower(c1) = jc.a and lower(c2) = jc.b left join jp ji on lower(i1) = ji.a and lower(i2) = ji.b),
gated as (select * from nm where name_sim >= 0.85 and not (coalesce({first_word('n1')} = {first_word('n2')} and {first_word('n1')} in {inlist(m.GENERIC_PREFIXES)}, false) and name_sim < 0.94) and not (coalesce(lower(s1) <> lower(s2), false) and name_sim < 0.95)),
sc0 as (select *, 0.5::double * city_sim + 0.3::double * (case when lower(s1) = lower(s2) then 1 else 0 end) + 0.2::double * (case when lower(k1) = lower(k2) then 1 else 0 end) loc_sim, case when p1 = p2 then 1.0::double else 0.0::double end phone_sim,
 case when e1 <> 0 and e2 <> 0 then least(e1, e2)::double / greatest(e1, e2) else 0.0::double end emp_sim from gated),
sc1 as (select *, least(1.0::double, (0.45::double * name_sim + 0.25::double * loc_sim + 0.15::double * industry_sim + 0.10::double * phone_sim + 0.05::double * emp_sim) / 1.0::double) score,
 (case when loc_sim > 0.5 then 1 else 0 end) + (case when industry_sim > 0.7 then 1 else 0 end) + (case when phone_sim > 0.5 then 1 else 0 end) + (case when emp_sim > 0.5 then 1 else 0 end) dims from sc0),
prob as (select id1, id2, case when score >= 0.82 then 'probabilistic_high' else 'probabilistic_medium' end match_type, score conf,
 array_to_string(list_filter([case when list_has_any(d1, d2) then 'domain' end, case when name_sim > 0.75 then 'name' end, case when l1 = l2 then 'linkedin_url' end, case when p1 = p2 then 'phone' end, case when city_sim > 0.85 then 'city' end, case when lower(s1) = lower(s2) then 'state' end, case when industry_sim > 0.85 then 'industry' end], lambda v: v is not null), ', ') fields,
 (case when score >= 0.82 then 'High' else 'Medium' end) || ' similarity match (score: ' || format('{{:.3f}}', round(score, 3)) || ')' explanation
 from sc1 where (dims >= 2 or name_sim >= 0.92) and score >= 0.72)"""


def matches(rows: str) -> str:
    return f"""mt0 as (select id1, id2, match_type, conf, fields, explanation from det union all select id1, id2, match_type, conf, fields, explanation from prob),
mt as (select mt0.*, case when x.survivor_score >= y.survivor_score then id1 else id2 end survivor, case match_type when 'deterministic_high' then 'auto_merge' when 'deterministic_medium' then 'review_merge' when 'probabilistic_high' then 'review_merge' else 'manual_review' end as "action"
 from mt0 join {rows} x on id1 = x.record_id join {rows} y on id2 = y.record_id),
reach(src, dst) as (select id1, id2 from mt union select id2, id1 from mt union select id1, id1 from mt union select id2, id2 from mt),
walk as (select src, dst from reach union select walk.src, reach.dst from walk join reach on walk.dst = reach.src),
comp as (select src as node, min(dst) as component from walk group by src),
clu as (select 'cluster_' || row_number() over (order by component) as cluster_id, members, size from (select component, list_sort(list(node)) members, count(*) as size from comp group by component having count(*) > 1))"""


CT = f"""ct0 as (select record_id, {missing(strip('lower(email)'))} as email, {person_name('first_name')} as first_name, {person_name('last_name')} as last_name, company_name, job_title, {linkedin_person('linkedin_url')} as linkedin_url,
 {derived_domain(None, missing(strip('lower(email)')))} as company_domain, lifecycle_stage, last_activity_date from fx_contacts),
ct1 as (select *, {missing(strip("coalesce(first_name, '') || ' ' || coalesce(last_name, '')"))} as name, case when last_name is not null and first_name is not null then lower(last_name) || '_' || lower(first_name)[1] else lower(last_name) end as block_key,
 {completeness(q.CONTACT_KEYS)} as completeness_score, case when last_activity_date is not null or upper(lifecycle_stage) in {inlist(q.CONTACT_ENGAGED)} then 1.0::double else 0.0::double end as engagement_score from ct0),
ct2 as (select *, completeness_score * 0.7::double + engagement_score * 0.3::double as data_quality_score from ct1),
ct as (select *, data_quality_score * 0.30::double + {recency('last_activity_date')} * 0.30::double + {stages('lifecycle_stage', q.CONTACT_STAGES)} * 0.20::double as survivor_score from ct2)"""

CTD = f"""r1 as (select a.record_id id1, b.record_id id2, a.email as key, 1 rule_rank, 'deterministic_high' match_type, 0.98::double conf, 'email' fields, 'Exact email match: ' || a.email explanation from ct a join ct b on a.email = b.email and a.record_id < b.record_id),
r2 as (select a.record_id id1, b.record_id id2, a.linkedin_url as key, 2 rule_rank, 'deterministic_high' match_type, 0.96::double conf, 'linkedin_url' fields, 'Exact LinkedIn URL match: ' || a.linkedin_url explanation from ct a join ct b on a.linkedin_url = b.linkedin_url and a.record_id < b.record_id),
ndp as (select a.record_id id1, b.record_id id2, a.block_key || ' @ ' || a.company_domain as key, a.name n1, b.name n2 from ct a join ct b on a.block_key = b.block_key and a.company_domain = b.company_domain and a.record_id < b.record_id
 where not coalesce(case when a.email is not null and b.email is not null then {email_domain('a.email')} <> {email_domain('b.email')} end, false)),
{jw('jd', 'select n1 a, n2 b from ndp')},
r3 as (select id1, id2, key, 3 rule_rank, 'deterministic_medium' match_type, 0.88::double conf, 'first_name, last_name, company_domain' fields, 'Same name + company domain: ' || key explanation from ndp join jd on n1 = a and n2 = b where s >= 0.85),
det as (select * exclude (rn) from (select *, row_number() over (partition by id1, id2 order by rule_rank, key) rn from (select * from r1 union all select * from r2 union all select * from r3)) where rn = 1)"""

CTP = f"""bc as (select record_id id, block_key as key from (select *, row_number() over (partition by block_key order by record_id) nth from ct where block_key is not null) where nth <= 100),
cand as (select a.id id1, b.id id2 from bc a join bc b on a.key = b.key and a.id < b.id),
lft as (select id1, id2 from cand anti join det using (id1, id2)),
sides as (select id1, id2, x.name n1, y.name n2, x.first_name f1, y.first_name f2, x.last_name g1, y.last_name g2, x.email m1, y.email m2, x.company_name c1, y.company_name c2, x.company_domain d1, y.company_domain d2, x.job_title t1, y.job_title t2
 from lft join ct x on id1 = x.record_id join ct y on id2 = y.record_id),
{jw('jp', 'select n1 a, n2 b from sides union select c1, c2 from sides union select t1, t2 from sides union select f1, f2 from sides union select g1, g2 from sides')},
nm as (select sides.*, coalesce(jn.s, 0) name_sim, coalesce(jc.s, 0) company_sim, coalesce(jt.s, 0) title_sim, coalesce(jf.s, 0) first_sim, coalesce(jg.s, 0) last_sim, coalesce(nullif({email_domain('m1')}, '') <> nullif({email_domain('m2')}, ''), false) as cross_dom
 from sides left join jp jn on n1 = jn.a and n2 = jn.b left join jp jc on c1 = jc.a and c2 = jc.b left join jp jt on t1 = jt.a and t2 = jt.b left join jp jf on f1 = jf.a and f2 = jf.b left join jp jg on g1 = jg.a and g2 = jg.b),
gated as (select * from nm where name_sim >= 0.80 and not (cross_dom and name_sim < 0.95)),
sc1 as (select *, least(1.0::double, (0.55::double * name_sim + 0.25::double * company_sim + 0.15::double * title_sim + 0.05::double * (case when d1 = d2 then 1 else 0 end)) / 1.0::double) score,
 (case when company_sim > 0.7 then 1 else 0 end) + (case when title_sim > 0.7 then 1 else 0 end) + (case when d1 = d2 then 1 else 0 end) dims from gated),
prob as (select id1, id2, case when cross_dom then 'probabilistic_medium' when score >= 0.82 then 'probabilistic_high' else 'probabilistic_medium' end match_type, case when cross_dom then round(name_sim * 0.85::double, 4) else score end conf,
 array_to_string(list_filter([case when m1 = m2 then 'email' end, case when first_sim > 0.8 then 'first_name' end, case when last_sim > 0.8 then 'last_name' end, case when company_sim > 0.7 then 'company_name' end, case when d1 = d2 then 'company_domain' end, case when title_sim > 0.7 then 'job_title' end], lambda v: v is not null), ', ') fields,
 case when cross_dom then 'Same name across different organizations (name similarity ' || {percent('name_sim')} || ')' else (case when score >= 0.82 then 'High' else 'Medium' end) || ' similarity match (score: ' || format('{{:.3f}}', round(score, 3)) || ')' end explanation
 from sc1 where (dims > 1 or name_sim >= 0.90) and (cross_dom or score >= 0.68))"""

COMPANY = f"with recursive {FX},\n{CO},\n{COD},\n{COP},\n{matches('co')}\n"
CONTACT = f"with recursive {FX},\n{CT},\n{CTD},\n{CTP},\n{matches('ct')}\n"
