"""Queries by name, with their SQL for DuckDB: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import storage
from ..functions import quality as q, similarity as s, text as t
from ..operators import entities, filters, matching as m
from ..operators.asof import asof_join
from ..operators.bounded import cand_bounded
from ..operators.cursors import all_pages
from ..operators.golden import golden_records
from ..operators.history import advanced, components_at, table_at
from ..operators.sessions import activity, sessions, tumbling
from ..schema import COMPANY_COLUMNS, COMPANY_FIELDS, MATCH_TYPES, company_settings, contact_settings
from ..sources import export, records
from . import incremental, oracle as o, pipeline, reports
from .fixtures import AS_OF, load, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def scalar(name: str, fixture: str, value: Callable[[], Column], sql: str) -> None:
    query(name, f"with {o.FX} select record_id, {sql} as result from {fixture}")(lambda spark, d: load(spark, d, fixture).select("record_id", value().alias("result")))


c = F.col
scalar("norm_domain", "fx_companies", lambda: t.norm_domain(c("domain")), o.norm_domain("domain"))
scalar("url_netloc", "fx_companies", lambda: t.url_netloc(c("website")), o.netloc("website"))
scalar("root_domain", "fx_companies", lambda: t.root_domain(t.norm_domain(c("domain"))), o.root_domain(o.norm_domain("domain")))
scalar("norm_phone", "fx_companies", lambda: t.norm_phone(c("phone")), o.norm_phone("phone"))
scalar("norm_state", "fx_companies", lambda: t.norm_state(c("state")), o.norm_state("state"))
scalar("norm_city_country", "fx_companies", lambda: F.concat_ws("/", t.norm_place(c("city")), t.norm_place(c("country"))), f"concat_ws('/', {o.place('city')}, {o.place('country')})")
scalar("norm_company_name", "fx_companies", lambda: t.norm_company_name(c("name")), o.norm_company_name("name"))
scalar("norm_linkedin_company", "fx_companies", lambda: t.norm_linkedin_company(c("linkedin_url")), o.linkedin_company("linkedin_url"))
scalar("block_key_company", "fx_companies", lambda: t.block_key_company(t.norm_company_name(c("name"))), o.block_company(o.norm_company_name("name")))
scalar("split_additional_domains", "fx_companies", lambda: F.array_join(t.split_additional_domains(c("additional_domains")), "|"), f"array_to_string({o.additional('additional_domains')}, '|')")
scalar("generate_id", "fx_companies", lambda: t.generate_id(c("name"), c("domain")), "md5(concat_ws('|', name, domain))[1:12]")
scalar("null_placeholder", "fx_companies", lambda: t.null_placeholder(c("domain")), "coalesce(nullif(domain, ''), '—')")
scalar("csv_escape", "fx_companies", lambda: t.csv_escape(F.concat(c("name"), F.lit(', "x"'))), """'"' || replace(name || ', "x"', '"', '""') || '"'""")
scalar("norm_email", "fx_contacts", lambda: t.norm_email(F.concat(F.lit(" "), F.upper("email"))), o.missing(o.strip("lower(' ' || upper(email))")))
scalar("norm_person_name", "fx_contacts", lambda: t.norm_person_name(F.concat(F.lit("o'"), F.upper("last_name"), F.lit("-x y"))), o.person_name("'o''' || upper(last_name) || '-x y'"))
scalar("norm_linkedin_person", "fx_contacts", lambda: t.norm_linkedin_person(c("linkedin_url")), o.linkedin_person("linkedin_url"))
scalar("email_domain", "fx_contacts", lambda: t.email_domain(c("email")), o.email_domain("email"))
scalar("full_name", "fx_contacts", lambda: t.full_name(c("first_name"), c("last_name")), "trim(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))")
scalar("company_domain_derive", "fx_contacts", lambda: t.company_domain_derive(F.when(F.length("email") % 2 == 0, F.concat(F.lit("http://www."), "company_name", F.lit("/x"))), c("email")), o.derived_domain("(case when length(email) % 2 = 0 then 'http://www.' || company_name || '/x' end)", "email"))
scalar("block_key_contact", "fx_contacts", lambda: t.block_key_contact(c("first_name"), c("last_name")), "lower(last_name) || '_' || lower(first_name)[1]")
scalar("int_parse", "fx_companies", lambda: records.int_parse(F.concat(c("employee_count").cast("string"), F.when(c("employee_count") % 2 == 0, ".7").when(c("employee_count") % 5 == 0, "x").otherwise(""))), "case when employee_count % 2 = 0 or employee_count % 5 <> 0 then employee_count end")
scalar("coalesce_mapping", "fx_companies", lambda: records.coalesce_mapping([c("website"), c("domain")]), "coalesce(domain, website)")
scalar("raw_data_map", "fx_companies", lambda: F.to_json(records.raw_data_map(["lead_status", "owner_id"])), """'{' || concat_ws(',', '"lead_status":"' || lead_status || '"', '"owner_id":"' || owner_id || '"') || '}'""")
scalar("recency", "fx_companies", lambda: F.round(q.recency(c("last_activity_date"), AS_OF), 6), f"round({o.recency('last_activity_date')}, 6)")


def companies(spark: SparkSession, d: str) -> DataFrame:
    return storage.saved(entities.with_survivor_score(entities.normalize_company(load(spark, d, "fx_companies")), "company", AS_OF), "companies")


def contacts(spark: SparkSession, d: str) -> DataFrame:
    return storage.saved(entities.with_survivor_score(entities.normalize_contact(load(spark, d, "fx_contacts")), "contact", AS_OF), "contacts")


COMPANY_SHOW = ["record_id", "name", "domain", "linkedin_url", "phone", "state", "city", "country", "block_key"]
CONTACT_SHOW = ["record_id", "name", "email", "first_name", "last_name", "linkedin_url", "company_domain", "block_key"]
query("normalize_company", f"{o.COMPANY} select {', '.join(COMPANY_SHOW)}, array_to_string(all_domains, ',') as all_domains from co")(lambda spark, d: companies(spark, d).select(*COMPANY_SHOW, F.array_join(F.sort_array("all_domains"), ",").alias("all_domains")))
query("normalize_contact", f"{o.CONTACT} select {', '.join(CONTACT_SHOW)} from ct")(lambda spark, d: contacts(spark, d).select(*CONTACT_SHOW))
query("all_domains", f"{o.COMPANY} select record_id, array_to_string(all_domains, ',') as result from co")(lambda spark, d: companies(spark, d).select("record_id", F.array_join(F.sort_array("all_domains"), ",").alias("result")))
query("array_except_primary", f"{o.COMPANY} select record_id, array_to_string(list_filter(all_domains, lambda v: domain is null or v <> domain), ',') as result from co")(
    lambda spark, d: companies(spark, d).select("record_id", F.array_join(F.sort_array(F.when(c("domain").isNotNull(), F.array_except("all_domains", F.array("domain"))).otherwise(c("all_domains"))), ",").alias("result"))
)
for _key, _value in {"completeness": "completeness_score", "engagement": "engagement_score", "data_quality": "data_quality_score", "survivor_score_company": "survivor_score"}.items():
    query(_key, f"{o.COMPANY} select record_id, round({_value}, 6) as result from co")(lambda spark, d, v=_value: companies(spark, d).select("record_id", F.round(v, 6).alias("result")))
query("survivor_score_contact", f"{o.CONTACT} select record_id, round(survivor_score, 6) as result from ct")(lambda spark, d: contacts(spark, d).select("record_id", F.round("survivor_score", 6).alias("result")))


# similarities, over names of parts that share a phone
_PARTS = "pp as (select a.record_id id1, b.record_id id2, a.name n1, b.name n2, a.city c1, b.city c2, a.state s1, b.state s2, a.employee_count e1, b.employee_count e2 from fx_part a join fx_part b on a.phone = b.phone and a.record_id < b.record_id)"


def part_pairs(spark: SparkSession, d: str, *also: str, similar: str | None = None) -> DataFrame:
    keys = m.keyed(load(spark, d, "fx_part"), c("phone"), *also)
    pairs = m.pairs_of(keys, *also)
    return m.with_value_sim(pairs, keys, similar, "sim") if similar else pairs


query("jaro_winkler", f"with {o.FX}, {_PARTS}, {o.jw('j', 'select n1 a, n2 b from pp')} select id1, id2, round(s, 9) as result from pp join j on n1 = a and n2 = b")(lambda spark, d: part_pairs(spark, d, "name", similar="name").select("id1", "id2", F.round("sim", 9).alias("result")))
query("location_similarity", f"with {o.FX}, {_PARTS}, {o.jw('j', 'select c1 a, c2 b from pp')} select id1, id2, round(0.5 * s + case when lower(s1) = lower(s2) then 0.3 else 0 end, 9)::double as result from pp join j on c1 = a and c2 = b")(
    lambda spark, d: part_pairs(spark, d, "city", "state", similar="city").select("id1", "id2", F.round(s.location_similarity(c("sim"), c("state1"), c("state2"), F.lit(None), F.lit(None)), 9).alias("result"))
)
query("employee_similarity", f"with {o.FX}, {_PARTS} select id1, id2, round(case when e1 <> 0 and e2 <> 0 then least(e1, e2)::double / greatest(e1, e2) else 0 end, 9) as result from pp")(lambda spark, d: part_pairs(spark, d, "employee_count").select("id1", "id2", F.round(s.employee_similarity(c("employee_count1"), c("employee_count2")), 9).alias("result")))

# rules
_RULE = "id1, id2, key, match_type, conf as confidence_score, fields as matching_fields, explanation"


def shown_rule(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", "key", "match_type", "confidence_score", F.array_join("matching_fields", ", ").alias("matching_fields"), "explanation")


for _key, _rule, _cte, _of in (
    ("det_company_domain", m.det_company_domain, "r1", "company"), ("det_company_root", m.det_company_root, "r2", "company"), ("det_company_linkedin", m.det_company_linkedin, "r3", "company"), ("det_company_phone", m.det_company_phone, "r4", "company"),
    ("det_contact_email", m.det_contact_email, "r1", "contact"), ("det_contact_linkedin", m.det_contact_linkedin, "r2", "contact"), ("det_contact_name_domain", m.det_contact_name_domain, "r3", "contact"),
):
    query(_key, f"{o.COMPANY if _of == 'company' else o.CONTACT} select {_RULE} from {_cte}")(lambda spark, d, r=_rule, k=_of: shown_rule(r(companies(spark, d) if k == "company" else contacts(spark, d))))

_MATCH = "id1, id2, match_type, round(conf, 6) as confidence_score, fields as matching_fields, explanation"


def shown(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", "match_type", F.round("confidence_score", 6).alias("confidence_score"), F.array_join("matching_fields", ", ").alias("matching_fields"), "explanation")


@query("rule_precedence", f"{o.COMPANY} select id1, id2, rule_rank, match_type from det")
def rule_precedence(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.deterministic("company", companies(spark, d)).select("id1", "id2", "rule_rank", "match_type")


query("det_company_url", f"with {o.FX}, k as (select distinct {o.netloc('website')} as key, record_id as id from fx_pages) select a.id as id1, b.id as id2, a.key from k a join k b on a.key = b.key and a.id < b.id")(
    lambda spark, d: m.pairs_of(m.keyed(load(spark, d, "fx_pages"), t.url_netloc(c("website")))).select("id1", "id2", "key")
)

# candidates
_PB = f"pb as (select record_id, {o.block_company('name')} as block_key from fx_part), pc as (select record_id, block_key, row_number() over (partition by block_key order by record_id) as nth from pb where block_key is not null)"


def part_blocks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "fx_part").select("record_id", t.block_key_company(c("name")).alias("block_key"))


query("block_cap", f"with {o.FX}, {_PB} select record_id, block_key, cast(nth as int) as nth from pc where nth <= 150")(lambda spark, d: m.block_cap(part_blocks(spark, d), 150))
def blocked_sql(cap: int) -> str:
    return f"with {o.FX}, {_PB} select a.record_id as id1, b.record_id as id2 from pc a join pc b on a.block_key = b.block_key and a.record_id < b.record_id where a.nth <= {cap} and b.nth <= {cap}"


# the caps of the reported method, and all records of a block
for _key, _cap in (("cand_blocked_company", company_settings().block_cap), ("cand_blocked_contact", contact_settings().block_cap), ("cand_blocked", None)):
    query(_key, blocked_sql(_cap or 1 << 40))(lambda spark, d, cap=_cap: m.cand_blocked(part_blocks(spark, d), cap))
query("cand_bounded", f"with {o.FX}, {_PB}, pn as (select p.record_id id, block_key as key, name from pb p join fx_part using (record_id) where block_key is not null), {o.jw('j', 'select a.name a, b.name b from pn a join pn b on a.key = b.key')} select x.id as id1, y.id as id2, round(s, 6) as name_sim from pn x join pn y on x.key = y.key and x.id < y.id join j on x.name = j.a and y.name = j.b where s >= 0.85")(
    lambda spark, d: cand_bounded(load(spark, d, "fx_part").withColumn("block_key", t.block_key_company(c("name"))), 0.85, decimals=6)
)
query("cand_all_pairs", "select a.n_name as id1, b.n_name as id2 from nation a join nation b on a.n_name < b.n_name")(lambda spark, d: m.cand_all_pairs(table(spark, d, "nation").select(c("n_name").alias("record_id"))))
query("anti_exclude", f"{o.CONTACT} select id1, id2 from lft")(lambda spark, d: (lambda rows: m.unmatched("contact", m.candidates(rows, contact_settings()), rows))(contacts(spark, d)))
def domain_without_phone(rows: DataFrame) -> DataFrame:
    """Pairs of one domain that the rule on phones does not match, each asked for itself."""
    pairs = m.pairs_by_first_rule("company", rows, "phone", "name", ranks=(1,))
    return pairs.where(~F.when(m.same("phone1", "phone2"), s.jaro_winkler(c("name1"), c("name2")) >= 0.75).otherwise(False))


query("except_pairs", f"{o.COMPANY} select id1, id2 from r1 except select id1, id2 from r4")(
    lambda spark, d: domain_without_phone(companies(spark, d)).select("id1", "id2")
)
query("distinct_pairs", f"{o.COMPANY} select id1, id2 from (select id1, id2 from r1 union select id1, id2 from r2 union select id1, id2 from r4)")(
    lambda spark, d: m.pairs_by_first_rule("company", companies(spark, d), ranks=(1, 2, 4)).select("id1", "id2")
)
query("intersect_domains", f"{o.COMPANY} select id1, id2, list_has_any(d1, d2) as result from sides")(
    lambda spark, d: (lambda rows: m.both_sides(company_left(rows), rows, ["all_domains"]).select("id1", "id2", F.arrays_overlap("all_domains1", "all_domains2").alias("result")))(companies(spark, d))
)
query("index_group", f"{o.COMPANY} select key, array_to_string(list_sort(list(id)), ',') as ids from dom group by key having count(*) > 1")(
    lambda spark, d: companies(spark, d).select(F.explode("all_domains").alias("key"), "record_id").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("record_id")), ",").alias("ids"), F.count("*").alias("n")).where("n > 1").select("key", "ids")
)


# probabilistic matches
def company_left(rows: DataFrame) -> DataFrame:
    return m.unmatched("company", m.candidates(rows, company_settings()), rows)


def company_similar(rows: DataFrame) -> DataFrame:
    return m.unmatched("company", m.candidates_by_name(rows, company_settings()), rows)


def contact_similar(rows: DataFrame) -> DataFrame:
    return m.unmatched("contact", m.candidates_by_name(rows, contact_settings()), rows)


def company_named(rows: DataFrame) -> DataFrame:
    return m.with_name_sim(m.both_sides(company_left(rows), rows, m.COMPANY_SIDES))


def contact_named(rows: DataFrame) -> DataFrame:
    left = m.unmatched("contact", m.candidates(rows, contact_settings()), rows)
    return m.with_name_sim(m.both_sides(left, rows, m.CONTACT_SIDES)).withColumn("cross", m.cross_domain())


_SIM = "select id1, id2, round(name_sim, 6) as name_sim"


def sims(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", F.round("name_sim", 6).alias("name_sim"))


def scores(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", F.round("score", 6).alias("score"), c("dims").cast("int").alias("dims"))


query("name_similarity", f"{o.COMPANY} {_SIM} from nm")(lambda spark, d: sims(company_named(companies(spark, d))))
query("gate_min_name", f"{o.COMPANY} {_SIM} from nm where name_sim >= 0.85")(lambda spark, d: sims(company_named(companies(spark, d)).where("name_sim >= 0.85D")))
query("gate_company", f"{o.COMPANY} {_SIM} from gated")(lambda spark, d: sims(m.gate_company(company_named(companies(spark, d)), company_settings())))
query("gate_cross_domain", f"{o.CONTACT} {_SIM} from gated")(lambda spark, d: sims(m.gate_contact(contact_named(contacts(spark, d)), contact_settings())))
query("score_company", f"{o.COMPANY} select id1, id2, round(score, 6) as score, dims from sc1")(lambda spark, d: scores(m.score_company(m.gate_company(company_named(companies(spark, d)), company_settings()), company_settings())))
query("score_contact", f"{o.CONTACT} select id1, id2, round(score, 6) as score, dims from sc1")(lambda spark, d: scores(m.score_contact(m.gate_contact(contact_named(contacts(spark, d)), contact_settings()), contact_settings())))
query("gate_sparse_company", f"{o.COMPANY} select id1, id2, round(score, 6) as score, dims from sc1 where dims >= 2 or name_sim >= 0.92")(
    lambda spark, d: scores(m.score_company(m.gate_company(company_named(companies(spark, d)), company_settings()), company_settings()).where("dims >= 2 or name_sim >= 0.92D"))
)
query("gate_sparse_contact", f"{o.CONTACT} select id1, id2, round(score, 6) as score, dims from sc1 where dims > 1 or name_sim >= 0.90")(
    lambda spark, d: scores(m.score_contact(m.gate_contact(contact_named(contacts(spark, d)), contact_settings()), contact_settings()).where("dims > 1 or name_sim >= 0.90D"))
)
query("classify", f"{o.COMPANY} select id1, id2, case when score >= 0.82 then 'probabilistic_high' when score >= 0.72 then 'probabilistic_medium' end as match_type from sc1")(
    lambda spark, d: m.score_company(m.gate_company(company_named(companies(spark, d)), company_settings()), company_settings()).select("id1", "id2", m.classify(c("score"), company_settings()).alias("match_type"))
)
query("probabilistic_company", f"{o.COMPANY} select {_MATCH} from prob")(lambda spark, d: (lambda rows: shown(m.probabilistic_company(rows, company_similar(rows), company_settings())))(companies(spark, d)))
query("probabilistic_contact", f"{o.CONTACT} select {_MATCH} from prob")(
    lambda spark, d: (lambda rows: shown(m.probabilistic_contact(rows, contact_similar(rows), contact_settings())))(contacts(spark, d))
)
query("cross_domain_match", f"{o.CONTACT} select {_MATCH} from prob where explanation like 'Same name across%'")(
    lambda spark, d: (lambda rows: shown(m.probabilistic_contact(rows, contact_similar(rows), contact_settings())).where("explanation like 'Same name across%'"))(contacts(spark, d))
)


# whole runs
def company_run(spark: SparkSession, d: str) -> pipeline.Result:
    return pipeline.deduplicate(load(spark, d, "fx_companies"), "company", AS_OF)


def contact_run(spark: SparkSession, d: str) -> pipeline.Result:
    return pipeline.deduplicate(load(spark, d, "fx_contacts"), "contact", AS_OF)


def shown_matches(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", "match_type", F.round("confidence_score", 6).alias("confidence_score"), F.array_join("matching_fields", ", ").alias("matching_fields"), "explanation", "survivor", "action")


_RUN = f'select {_MATCH}, survivor, "action" from mt'
query("dedup_companies", f"{o.COMPANY} {_RUN}")(lambda spark, d: shown_matches(company_run(spark, d).matches))
query("dedup_contacts", f"{o.CONTACT} {_RUN}")(lambda spark, d: shown_matches(contact_run(spark, d).matches))
query("union_matches", f"{o.COMPANY} select id1, id2, match_type from mt")(lambda spark, d: pipeline.find_matches("company", companies(spark, d), company_settings()).select("id1", "id2", "match_type"))
query("recommend_survivor", f"{o.CONTACT} select id1, id2, survivor from mt")(lambda spark, d: contact_run(spark, d).matches.select("id1", "id2", "survivor"))
query("action", f'{o.COMPANY} select id1, id2, "action" from mt')(lambda spark, d: company_run(spark, d).matches.select("id1", "id2", "action"))
query("connected_components", f"{o.COMPANY} select node, component from comp")(lambda spark, d: company_run(spark, d).labels)
query("clusters", f"{o.CONTACT} select cluster_id, array_to_string(members, ',') as members from clu")(lambda spark, d: contact_run(spark, d).clusters.select("cluster_id", F.array_join("members", ",").alias("members")))
query("sort_members", f"{o.COMPANY} select members[1] as first_member, array_to_string(members, ',') as members from clu")(lambda spark, d: company_run(spark, d).clusters.select(F.get("members", F.lit(0)).alias("first_member"), F.array_join("members", ",").alias("members")))
query("cluster_size", f"{o.CONTACT} select cluster_id, size from clu")(lambda spark, d: contact_run(spark, d).clusters.select("cluster_id", "size"))
_DOMAIN = " union all ".join(f"select '{k}' as match_type" for k in MATCH_TYPES)
query("match_breakdown", f"{o.COMPANY} select v.match_type, count(mt.id1) as n_matches from ({_DOMAIN}) v left join mt on v.match_type = mt.match_type group by 1")(lambda spark, d: pipeline.match_breakdown(company_run(spark, d).matches))
query("summary", f"{o.CONTACT} select (select count(*) from ct) as total_entities, (select count(*) from mt) as total_matches, (select count(*) from clu) as total_clusters, (select cast(sum(size) - count(*) as bigint) from clu) as duplicates_to_remove, round((select sum(size) - count(*) from clu)::double / (select count(*) from ct) * 100, 6) as deduplication_rate")(
    lambda spark, d: pipeline.summary(contact_run(spark, d)).withColumn("deduplication_rate", F.round("deduplication_rate", 6))
)
query("cluster_survivor", f"{o.COMPANY} select cluster_id, round(survivor_score, 6) as survivor_score, record_id as survivor from (select cluster_id, survivor_score, record_id, row_number() over (partition by cluster_id order by survivor_score desc, record_id) rn from (select cluster_id, unnest(members) as record_id from clu) join co using (record_id)) where rn = 1")(
    lambda spark, d: pipeline.cluster_survivor(company_run(spark, d)).select("cluster_id", F.round("survivor_score", 6).alias("survivor_score"), "survivor")
)
_TABLE = """select id1 as "Company_1_ID", coalesce(x.name, '') as "Company_1_Name", coalesce(x.domain, '') as "Company_1_Domain", coalesce(x.city, '') as "Company_1_City", id2 as "Company_2_ID", coalesce(y.name, '') as "Company_2_Name", coalesce(y.domain, '') as "Company_2_Domain", coalesce(y.city, '') as "Company_2_City",
 match_type as "Match_Type", round(conf, 3) as "Confidence_Score", fields as "Matching_Fields", explanation as "Explanation", survivor as "Survivor_Recommendation", "action" as "Recommended_Action" from mt join co x on id1 = x.record_id join co y on id2 = y.record_id"""


@query("sink_csv_matches", f"{o.COMPANY} {_TABLE}")
def sink_csv_matches(spark: SparkSession, d: str) -> DataFrame:
    """The files that the sink wrote, read again."""
    run, path = company_run(spark, d), storage.new_path(spark, "matches-csv")
    export.sink_csv_matches(run, path)
    # a null value that no cell has, as empty cells are empty texts
    return spark.read.schema(pipeline.matches_table(run).schema).option("header", True).option("escape", '"').option("nullValue", "\0").csv(path)


query("fields_join", f"{o.CONTACT} select id1, id2, fields from mt")(lambda spark, d: contact_run(spark, d).matches.select("id1", "id2", F.array_join("matching_fields", ", ").alias("fields")))
query("sample_matches", f"{o.COMPANY} {_TABLE} order by 1, 5 limit 10")(lambda spark, d: pipeline.sample_matches(company_run(spark, d)))
query("lookup_entity", f"{o.CONTACT} select id1, id2, x.email as email_1, y.email as email_2 from mt join ct x on id1 = x.record_id join ct y on id2 = y.record_id")(lambda spark, d: pipeline.lookup_entity(contact_run(spark, d), "email").select("id1", "id2", "email_1", "email_2"))
query("sink_json_report", f"""{o.CONTACT} select id1 as contact_1_id, id2 as contact_2_id, coalesce(x.name, '—') as contact_1_name, coalesce(y.email, '—') as contact_2_email, coalesce(x.company_name, '—') as contact_1_company, round(conf, 3) as confidence_score, match_type, fields as matching_fields, explanation, survivor as survivor_recommendation, "action" as recommended_action from mt join ct x on id1 = x.record_id join ct y on id2 = y.record_id""")(
    lambda spark, d: report_matches(spark, contact_run(spark, d)).select(
        "contact_1_id", "contact_2_id", "contact_1_name", "contact_2_email", "contact_1_company", "confidence_score", "match_type", F.array_join("matching_fields", ", ").alias("matching_fields"), "explanation", "survivor_recommendation", "recommended_action"
    )
)


def report_matches(spark: SparkSession, run: pipeline.Result) -> DataFrame:
    """The matches of a report that the sink wrote, read again."""
    path = storage.new_path(spark, "report")
    export.sink_json_report(run, path, AS_OF)
    return spark.read.schema(pipeline.enriched_matches(run).schema).json(f"{path}/matches")


query("entity_dictionary", f"{o.COMPANY} select record_id as id, coalesce(name, '—') as name, coalesce(nullif(cast(employee_count as varchar), ''), '—') as employee_count from co where record_id in (select unnest(members) from clu)")(
    lambda spark, d: pipeline.entity_dictionary(company_run(spark, d)).select("id", "name", "employee_count")
)


# batches, one after another
def batches(spark: SparkSession, d: str, kind: str) -> incremental.State:
    """Two batches of one table's rows; the second also replaces rows of the first, which had other values."""
    rows = load(spark, d, "fx_companies" if kind == "company" else "fx_contacts")
    part = F.pmod(F.crc32(F.col("record_id").cast("binary")), F.lit(10))
    wrong = rows.where(part == 6).withColumn("name" if kind == "company" else "last_name", F.lit("Draft Name"))
    state = incremental.start(kind, rows.where(part < 6).unionByName(wrong), AS_OF)
    return incremental.add(state, rows.where(part >= 6), AS_OF)


query("incremental_companies", f"{o.COMPANY} {_RUN}")(lambda spark, d: shown_matches(batches(spark, d, "company").matches))
query("incremental_contacts", f"{o.CONTACT} {_RUN}")(lambda spark, d: shown_matches(batches(spark, d, "contact").matches))
query("incremental_clusters", f"{o.CONTACT} select node, component from comp")(lambda spark, d: batches(spark, d, "contact").labels)


# merges: a golden record for each cluster, with the sources of its fields
_WAYS = {"name": "longest", "email": "survivor", "job_title": "latest", "company_name": "most"}


@query("golden_records", f"""{o.CONTACT}, mem as (select cluster_id, unnest(members) as record_id from clu),
g as (select mem.cluster_id, ct.*, coalesce(epoch(try_cast(last_activity_date as timestamp)), -1e18) as changed from mem join ct using (record_id)),
best as (select cluster_id, 'name' as field, name as value, record_id, row_number() over (partition by cluster_id order by length(name) desc, survivor_score desc, record_id) as nth from g where name is not null
 union all select cluster_id, 'email', email, record_id, row_number() over (partition by cluster_id order by survivor_score desc, record_id) from g where email is not null
 union all select cluster_id, 'job_title', job_title, record_id, row_number() over (partition by cluster_id order by changed desc, survivor_score desc, record_id) from g where job_title is not null
 union all select cluster_id, 'company_name', company_name, id, row_number() over (partition by cluster_id order by n desc, id) from (select cluster_id, company_name, count(*) as n, min(record_id) as id from g where company_name is not null group by 1, 2))
select cluster_id, field, value, record_id as source from best where nth = 1""")  # fmt: skip
def golden_of_contacts(spark: SparkSession, d: str) -> DataFrame:
    run = contact_run(spark, d)
    found = golden_records(run.clusters.select("cluster_id", F.explode("members").alias("record_id")), run.entities, _WAYS, latest="last_activity_date")
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c(f).cast("string").alias("value"), F.try_element_at("sources", F.lit(f)).alias("source")) for f in _WAYS)))
    return found.select("cluster_id", long.alias("x")).select("cluster_id", "x.*").where("source is not null")


_LAST = "select user_id, ts, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events where {} group by 1, 2"


@query("asof_contacts", f"with {o.FX}, e as ({_LAST.format('true')}) select record_id, last_activity_date, e.ts as right_time, event_id, event_type from fx_contacts asof left join e on cast(record_id as bigint) = e.user_id and try_cast(last_activity_date as timestamp) >= e.ts")
def asof_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Each contact with the last event of its number up to its last activity."""
    people = load(spark, d, "fx_contacts").select("record_id", "last_activity_date", c("record_id").cast("bigint").alias("user_id"))
    return asof_join(people, table(spark, d, "events"), "user_id", "last_activity_date", "ts", ["event_id", "event_type"]).drop("user_id")


@query("asof_events", f"with e as ({_LAST.format(chr(39).join(('event_type = ', 'click', '')))}) select x.event_id, e.ts as right_time, e.event_id as click_id from events x asof left join e on x.user_id = e.user_id and x.ts > e.ts")
def asof_events(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's last click before it."""
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", c("event_id").alias("click_id"))
    return asof_join(events.select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "ts", ["click_id"], strict=True).select("event_id", "right_time", "click_id")


# sessions of users, which end after twelve hours without an event
_GAP = 12 * 3600
_SESSIONS = f"""t as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= {_GAP * 1_000_000} then 0 else 1 end as fresh from events),
u as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from t),
se as (select user_id, cast(session as bigint) as session, min(ts) as started, max(ts) as ended, count(*) as n, count(*) filter (where event_type = 'purchase') as purchases from u group by 1, 2)"""


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "user_id", "ts", _GAP, {"purchases": c("event_type") == "purchase"})


query("sessions", f"with {_SESSIONS} select * from se")(user_sessions)
query("tumbling_windows", "select user_id, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as started, count(*) as n, count(*) filter (where event_type = 'error') as errors from events group by 1, 2")(
    lambda spark, d: tumbling(table(spark, d, "events"), "user_id", "ts", "6 hours", {"errors": c("event_type") == "error"})
)
query("session_activity", f"with {_SESSIONS}, la as (select user_id, count(*) as n_sessions, strftime(max(ended), '%Y-%m-%dT%H:%M:%SZ') as last_activity_date from se group by 1) select *, round({o.recency('last_activity_date')}, 6) as recency, 1.0::double as engagement from la")(
    lambda spark, d: activity(user_sessions(spark, d), "user_id", AS_OF).withColumn("recency", F.round("recency", 6))
)


# reports by every set of columns; lines of orders stand for matches of orders and parts, as they are many
_LINES = "select cast(l_orderkey as string) as id1, concat('p', cast(l_partkey as string)) as id2, l_returnflag as kind, concat(l_linestatus, cast(l_linenumber as string)) as match_type, cast(l_suppkey % 7 as string) as domain, case when l_discount > 0 then l_discount * 10 end as confidence_score from lineitem"
_CUBE = ["kind", "match_type", "domain"]


def line_summaries(spark: SparkSession, d: str) -> DataFrame:
    """As they come from several batches: a row for each batch and combination."""
    rows = derived(spark, d, _LINES, "lineitem")
    return reports.summarised(rows.withColumn("batch", F.pmod(F.xxhash64("id1"), F.lit(3))), ["batch", *_CUBE])


query("report_cube", f"with x as ({_LINES}) select kind, match_type, domain, cast(grouping(kind) * 4 + grouping(match_type) * 2 + grouping(domain) as bigint) as level, cast(count(*) as bigint) as n_matches, cast(count(confidence_score) as bigint) as n_scored, round(coalesce(sum(confidence_score), 0), 2) as score_sum from x group by cube (kind, match_type, domain)")(
    lambda spark, d: reports.cube(line_summaries(spark, d), _CUBE).select(*_CUBE, "level", "n_matches", "n_scored", F.round(F.coalesce(c("score_sum").cast("double"), F.lit(0.0)), 2).alias("score_sum"))
)
query("report_sketches")(lambda spark, d: reports.cube(line_summaries(spark, d), _CUBE))


# merges, some undone, some of these done again: chains of up to eight customers
_CUT = "k % 8 = 0 or (k % 3 = 0 and k % 6 <> 0)"


@query("undo_merges", f"""with x as (select c_custkey as k, c_acctbal as survivor_score, {_CUT} as cut from customer), y as (select *, max(case when cut or not exists (select 1 from x b where b.k = x.k - 1) then k end) over (order by k) as part from x),
best as (select part, arg_max('r' || k, struct_pack(a := survivor_score, b := -k)) as survivor from y group by 1)
select 'r' || k as record_id, survivor, survivor <> 'r' || k as merged from y join best using (part)""")  # fmt: skip
def undo_merges(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(c("c_custkey").cast("bigint").alias("k"), F.concat(F.lit("r"), c("c_custkey").cast("string")).alias("record_id"), c("c_acctbal").alias("survivor_score"))
    last = people.agg(F.max("k")).first()[0] or 0
    merge = people.where("k % 8 <> 0").join(people.select((c("k") + 1).alias("k"), c("record_id").alias("id1")), "k")
    rows = [merge.select(c("k").alias("seq"), F.lit("merge").alias("action"), "id1", c("record_id").alias("id2"), F.lit(None).cast("long").alias("target"))]
    for turn, action, each in ((1, "undo", 3), (2, "redo", 6)):
        rows.append(merge.where(c("k") % each == 0).select((c("k") + turn * (last + 1)).alias("seq"), F.lit(action).alias("action"), F.lit(None).cast("string").alias("id1"), F.lit(None).cast("string").alias("id2"), c("k").alias("target")))
    log = storage.saved(rows[0].union(rows[1]).union(rows[2]), "log")
    labels = advanced(components_at(log, last), log, last)
    return table_at(people, labels)


# search requests, over orders
def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def where(*filters_: tuple) -> list[list[dict]]:
    return [[{"propertyName": n, "operator": op, "value": v[0] if v else None}] for n, op, *v in filters_]


# values that occur, so that each comparison differs from the others
for _op, _sql, _value in (("EQ", "=", 50), ("NEQ", "<>", 50), ("LT", "<", 50), ("LTE", "<=", 50), ("GT", ">", 50), ("GTE", ">=", 50)):
    query(f"op_{_op}", f"select o_orderkey, o_custkey from orders where o_custkey {_sql} {_value}")(lambda spark, d, op=_op, v=_value: filters.filter_groups(orders(spark, d), where(("o_custkey", op, v))).select("o_orderkey", "o_custkey"))
query("op_CONTAINS_TOKEN", "select o_orderkey, o_orderpriority from orders where o_orderpriority ilike '%-HIGH'")(lambda spark, d: filters.filter_groups(orders(spark, d), where(("o_orderpriority", "CONTAINS_TOKEN", "*-high"))).select("o_orderkey", "o_orderpriority"))
query("op_HAS_PROPERTY", f"with {o.FX} select record_id, email from fx_contacts where email is not null")(lambda spark, d: filters.filter_groups(load(spark, d, "fx_contacts"), where(("email", "HAS_PROPERTY"))).select("record_id", "email"))
query("op_NOT_HAS_PROPERTY", f"with {o.FX} select record_id, email from fx_contacts where email is null")(lambda spark, d: filters.filter_groups(load(spark, d, "fx_contacts"), where(("email", "NOT_HAS_PROPERTY"))).select("record_id", "email"))
_GROUPS = [[{"propertyName": "o_orderstatus", "operator": "EQ", "value": "F"}, {"propertyName": "o_totalprice", "operator": "GT", "value": 100000.0}], [{"propertyName": "o_custkey", "operator": "LT", "value": 50}]]
query("filter_groups", "select o_orderkey from orders where (o_orderstatus = 'F' and o_totalprice > 100000) or o_custkey < 50")(lambda spark, d: filters.filter_groups(orders(spark, d), _GROUPS).select("o_orderkey"))
query("scan_api_search", "select o_orderkey, o_totalprice from orders where (o_orderstatus = 'F' and o_totalprice > 100000) or o_custkey < 50 order by o_totalprice desc, o_orderkey limit 100")(
    lambda spark, d: filters.search(orders(spark, d), 500, ["o_orderkey", "o_totalprice"], _GROUPS, [("o_totalprice", "DESCENDING"), ("o_orderkey", "ASCENDING")])
)

query("api_pages", """with x as (select o_orderkey, o_orderstatus, o_totalprice, row_number() over (order by o_orderstatus desc, o_totalprice desc, o_orderkey) as n from orders where (o_orderstatus = 'F' and o_totalprice > 100000) or o_custkey < 50)
select cast((x.n - 1) // 100 + 1 as bigint) as page, cast((x.n - 1) % 100 + 1 as bigint) as nth, x.o_orderkey, x.o_totalprice, y.o_orderkey as after from x left join x y on y.n = (x.n - 1) // 100 * 100""")(
    lambda spark, d: all_pages(orders(spark, d), "o_orderkey", 100, ["o_orderkey", "o_totalprice"], _GROUPS, [("o_orderstatus", "DESCENDING"), ("o_totalprice", "DESCENDING")])
)

# JSON items, from events
_ITEM = """'{"id": ' || event_id || ', "properties": {"hs_object_id": "' || (case when event_id % 5 = 0 then 'h' || event_id else ' ' end) || '", "email": "U' || user_id || '@x.example", "kind": "' || event_type || '"}, "url": "https://x.example/' || event_id || '"}'"""


def event_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(f"{_ITEM} as item", "event_id as position")


query("json_item_to_record", "select case when event_id % 5 = 0 then 'h' || event_id else cast(event_id as varchar) end as record_id, 'U' || user_id || '@x.example' as email, event_type as kind from events")(
    lambda spark, d: records.json_item_to_record(event_items(spark, d), records.CONTACT_JSON_COLUMNS, records.CONTACT_FIELDS, "id", "properties").select("record_id", "email", F.try_element_at("raw_data", F.lit("kind")).alias("kind"))
)


def export_items(spark: SparkSession, d: str) -> DataFrame:
    props = F.create_map(F.lit("email"), F.concat(F.lit("u"), c("user_id").cast("string"), F.lit("@x.example")), F.lit("company"), F.concat(c("event_type"), F.lit(", Inc")))
    return table(spark, d, "events").select(c("event_id").alias("id"), F.concat(F.lit("https://x.example/"), c("event_id").cast("string")).alias("url"), props.alias("properties"))


query("sink_csv_contacts", """select concat_ws(',', event_id, 'u' || user_id || '@x.example', '', '', '"' || event_type || ', Inc"', '', '', 'https://x.example/' || event_id) as line from events""")(lambda spark, d: export.sink_csv_contacts(export_items(spark, d)))
query("sink_http_records", """select event_id as id, '{"records":[{"id":"hubspot-' || event_id || '","cells":{"email":"u' || user_id || '@x.example","first_name":"","last_name":"","company":"' || event_type || ', Inc","createdate":"","lifecyclestage":"","hubspot_url":"https://x.example/' || event_id || '"}}]}' as payload from events""")(
    lambda spark, d: export.sink_http_records(export_items(spark, d))
)


# files written and read again
def csv_round_trip(spark: SparkSession, d: str, fixture: str, renamed: dict[str, str], scan) -> DataFrame:
    path = storage.new_path(spark, "csv")
    rows = load(spark, d, fixture)
    rows.select(*(c(a).alias(b) for a, b in renamed.items())).write.option("header", True).option("escape", '"').csv(path)
    return scan(spark, path)


_CO_CSV = {"record_id": "Record ID", "name": "Company name", "domain": "Company Domain Name", "phone": "Phone Number", "employee_count": "Number of Employees", "owner_id": "mystery"}
query("scan_csv_company", f"with {o.FX} select record_id, trim(name) as name, domain, phone, employee_count from fx_companies")(lambda spark, d: csv_round_trip(spark, d, "fx_companies", _CO_CSV, records.scan_csv_company).select("record_id", F.trim("name").alias("name"), "domain", "phone", "employee_count"))
_CT_CSV = {"record_id": "Id", "first_name": "FirstName", "last_name": "LastName", "email": "Email", "company_name": "Company", "job_title": "Title"}
query("scan_csv_contact", f"with {o.FX} select record_id, first_name, last_name, email, company_name, job_title from fx_contacts")(lambda spark, d: csv_round_trip(spark, d, "fx_contacts", _CT_CSV, records.scan_csv_contact).select(*_CT_CSV))


def json_pages(spark: SparkSession, items: DataFrame) -> str:
    """The path of files with one document of at most some hundred items (id, properties) a line, as an API's pages are."""
    path = storage.new_path(spark, "json")
    pages = storage.parts(items.count(), 100)
    paged = items.groupBy(F.pmod(F.xxhash64("id"), F.lit(pages)).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "properties")).alias("results"))).alias("value"))
    paged.select("value").write.text(path)
    return path


@query("scan_json_contact", f"with {o.FX} select record_id, first_name, last_name, email from fx_contacts")
def scan_json_contact(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "fx_contacts").select(c("record_id").alias("id"), F.struct(c("first_name").alias("firstname"), c("last_name").alias("lastname"), c("email")).alias("properties"))
    return records.scan_json_contact(spark, json_pages(spark, rows), lines=True).select("record_id", "first_name", "last_name", "email")


@query("scan_json_company", f"with {o.FX} select record_id, name, domain, phone, employee_count, lead_status, owner_id as unmapped from fx_companies")
def scan_json_company(spark: SparkSession, d: str) -> DataFrame:
    properties = F.struct("name", "domain", "phone", c("employee_count").alias("numberofemployees"), c("lead_status").alias("hs_lead_status"), c("owner_id").alias("unmapped"))
    found = records.scan_json_company(spark, json_pages(spark, load(spark, d, "fx_companies").select(c("record_id").alias("id"), properties.alias("properties"))), lines=True)
    return found.select("record_id", "name", "domain", "phone", "employee_count", "lead_status", F.try_element_at("raw_data", F.lit("unmapped")).alias("unmapped"))


# operators inside of others, by themselves
query("pair_canonical", f"{o.CONTACT} select id1, id2, key from r1")(lambda spark, d: m.pairs_of(m.keyed(contacts(spark, d), c("email"))).select("id1", "id2", "key"))
query("api_sort", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 7")(lambda spark, d: filters.search(orders(spark, d), 7, ["o_orderkey"], None, [("o_totalprice", "DESCENDING"), ("o_orderkey", "ASCENDING")]))
query("api_limit", "select o_orderkey from orders order by o_orderkey limit 100")(lambda spark, d: filters.search(orders(spark, d), 1000, ["o_orderkey"], None, [("o_orderkey", "ASCENDING")]))
query("object_types", "select c_name as name, null::varchar as domain, null::varchar as createdate, c_mktsegment as industry, null::varchar as numberofemployees from customer order by c_name desc limit 100")(
    lambda spark, d: filters.search_objects(table(spark, d, "customer").select(c("c_name").alias("name"), *(F.lit(None).cast("string").alias(x) for x in ("domain", "createdate", "numberofemployees")), c("c_mktsegment").alias("industry")), "companies", 100, sorts=[("name", "DESCENDING")])
)
query("gate_generic_prefix", f"{o.COMPANY} {_SIM} from nm where not (coalesce({o.first_word('n1')} = {o.first_word('n2')} and {o.first_word('n1')} in {o.inlist(m.GENERIC_PREFIXES)}, false) and name_sim < 0.94)")(lambda spark, d: sims(m.gate_generic_prefix(company_named(companies(spark, d)))))
query("gate_location_mismatch", f"{o.COMPANY} {_SIM} from nm where not (coalesce(lower(s1) <> lower(s2), false) and name_sim < 0.95)")(lambda spark, d: sims(m.gate_location_mismatch(company_named(companies(spark, d)))))
query("gate_threshold", f"{o.COMPANY} select id1, id2, round(score, 6) as score, dims from sc1 where score >= 0.72")(
    lambda spark, d: scores(m.score_company(m.gate_company(company_named(companies(spark, d)), company_settings()), company_settings()).where(m.classify(c("score"), company_settings()).isNotNull()))
)
query("matching_fields_company", f"{o.COMPANY} select id1, id2, fields from prob")(lambda spark, d: (lambda rows: m.probabilistic_company(rows, company_similar(rows), company_settings()).select("id1", "id2", F.array_join("matching_fields", ", ").alias("fields")))(companies(spark, d)))
query("matching_fields_contact", f"{o.CONTACT} select id1, id2, fields from prob")(
    lambda spark, d: (lambda rows: m.probabilistic_contact(rows, contact_similar(rows), contact_settings()).select("id1", "id2", F.array_join("matching_fields", ", ").alias("fields")))(contacts(spark, d))
)
query("explanation", f"{o.COMPANY} select id1, id2, explanation from mt")(lambda spark, d: pipeline.find_matches("company", companies(spark, d), company_settings()).select("id1", "id2", "explanation"))


# gates inside of rules, over rows that they part
def derived(spark: SparkSession, d: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=table(spark, d, source))


_ROOTS = """select cast(c_custkey as string) as record_id, case c_custkey % 5 when 0 then concat('d', cast(c_custkey as string), '.nhs.uk') when 1 then 't.co' when 2 then 'dept.harvard.edu'
 else concat('www.s', cast(c_custkey % 17 as string), '.example') end as domain from customer"""
query("gate_generic_root", f"with x as ({_ROOTS}), k as (select record_id as id, {o.root_domain('domain')} as key from x) select id, key from k where key not in {o.inlist(m.GENERIC_ROOTS)} and length(key) >= 5")(
    lambda spark, d: m.gate_generic_root(m.keyed(derived(spark, d, _ROOTS, "customer"), t.root_domain(c("domain")))).select("id", "key")
)
# slugs that one to six records share, in turns of a hundred records; every fourth turn has short ones
_SLUGS = """select cast(k as string) as record_id, concat('linkedin.com/company/', case when turn % 4 = 3 then concat('s', cast(cast(floor(k / 2) as bigint) as string)) else concat('long-slug-', cast(turn as string), '-', cast(cast(floor(k / (1 + turn % 6)) as bigint) as string)) end) as linkedin_url
from (select c_custkey as k, cast(floor(c_custkey / 100) as bigint) as turn from customer)"""
query("gate_linkedin", f"with x as ({_SLUGS}) select id, key from (select record_id as id, linkedin_url as key, count(*) over (partition by linkedin_url) as n from x where length(string_split(linkedin_url, '/')[-1]) >= 10) where n between 2 and 4")(
    lambda spark, d: m.gate_linkedin(derived(spark, d, _SLUGS, "customer")).select("id", "key")
)
_MAILS = "select o_custkey as key, cast(o_orderkey as string) as id, case when o_orderkey % 4 <> 0 then concat('u', cast(o_orderkey as string), '@', lower(o_orderstatus), '.example') end as email from orders"
query("gate_email_conflict", f"with x as ({_MAILS}) select a.id as id1, b.id as id2 from x a join x b on a.key = b.key and a.id < b.id where a.email is null or b.email is null or {o.email_domain('a.email')} = {o.email_domain('b.email')}")(
    lambda spark, d: m.gate_email_conflict(m.pairs_of(derived(spark, d, _MAILS, "orders"), "email")).select("id1", "id2")
)

# rows with source columns, of which later ones win; rows without an id get their place, and those with an empty one go
_ROWS = """select case when c_custkey % 6 = 0 then null when c_custkey % 7 = 0 then '' else concat('r', cast(c_custkey as string)) end as `Record ID`, c_name as `Company name`, case when c_custkey % 2 = 0 then c_mktsegment end as `name`,
 concat(cast(c_custkey % 900 as string), case when c_custkey % 4 = 0 then 'x' else '.7' end) as `Number of Employees`, c_mktsegment as segment, c_custkey as place from customer"""


@query("row_to_record", """select coalesce(id, cast(place as varchar)) as record_id, name, case when place % 4 <> 0 then place % 900 end as employee_count, segment, place as position
from (select case when c_custkey % 6 = 0 then null when c_custkey % 7 = 0 then '' else 'r' || c_custkey end as id, case when c_custkey % 2 = 0 then c_mktsegment else c_name end as name, c_mktsegment as segment, c_custkey as place from customer) where id is null or id <> ''""")  # fmt: skip
def row_to_record(spark: SparkSession, d: str) -> DataFrame:
    found = records.mapped(derived(spark, d, _ROWS, "customer"), COMPANY_COLUMNS, COMPANY_FIELDS, c("place"))
    return found.select("record_id", "name", "employee_count", F.try_element_at("raw_data", F.lit("segment")).alias("segment"), "position")
