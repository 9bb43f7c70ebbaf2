"""Entities made from the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01T00:00:00Z"

PAGES = """
select cast(page_id as string) as record_id, url as website, split_part(url,'/',3) as host,
  split_part(regexp_replace(split_part(url,'/',3),'^(www|m|blog)[.]',''),'.',1) as name
from pages"""

PARTS = """
select cast(p_partkey as string) as record_id, p_name as name, p_type as industry, p_brand as state,
  split_part(p_name,' ',2) as city, cast(p_size as bigint) as employee_count,
  case when p_partkey % 3 = 0 then concat('617-555-', lpad(cast(p_partkey % 97 as string),4,'0')) end as phone
from part"""

CONTACTS = """
select cast(k as string) as record_id, case when k % 7 = 3 then concat(substring(first_name, 1, 1), 'qzuvwxkt') when k % 7 = 5 then concat(first_name, 'abella') else first_name end as first_name, last_name,
 case when k % 11 = 0 then null else concat(lower(first_name),'.',lower(last_name),case when k % 7 = 0 then '1' else '' end,'@',dom) end as email,
 case when k % 4 = 0 then null else dom end as company_name,
 split_part('Nurse,Buyer,Director,Analyst',',',cast(k % 4 + 1 as int)) as job_title,
 case when k % 13 = 0 then concat('https://www.linkedin.com/in/u',cast(k % 130 as string),'?t=1') end as linkedin_url,
 split_part('customer,opportunity,lead,subscriber',',',cast((k % 9) % 4 + 1 as int)) as lifecycle_stage,
 case when k % 3 = 0 then concat('2024-01-',lpad(cast(k % 28 + 1 as string),2,'0'),'T00:00:00Z') end as last_activity_date
from (select c_custkey as k,
  split_part('Ann,Ben,Cleo,Dan,Eva,Finn,Gia,Hal,Iris,Jon,Kay,Leo,Mia,Ned,Ona,Pam,Quin,Rex,Sue,Tom',',',cast(c_custkey % 20 + 1 as int)) as first_name,
  split_part('Abbot,Baker,Carver,Dyer,Ellis,Fisher,Grant,Hooper,Irwin,Joyner,Keller,Lowell,Mason,Nash,Oakley,Porter,Quill,Rhodes,Sawyer,Tanner,Usher,Vance,Weaver,Xander,York,Zeller,Ashby,Booker,Cooper,Draper,Easton',',',cast((c_custkey * 7) % 31 + 1 as int)) as last_name,
  split_part('alpha.example,beta.example,gamma.example,delta.example,epsilon.example',',',cast((case when c_custkey % 3 = 0 then c_custkey % 7 else c_custkey % 620 end) % 5 + 1 as int)) as dom
 from customer)"""

COMPANIES = """
select cast(k as string) as record_id,
 concat(word, ' ', split_part('Widgets,Systems,Foods,Energy,Motors,Labs,Paper,Textiles,Optics,Mining,Media',',',cast((k * 5) % 11 + 1 as int)), ' ', split_part('Inc.,LLC,Group,Holdings Ltd,Hospital,,Works',',',cast(k % 7 + 1 as int))) as name,
 case when k % 5 = 0 then null when k % 5 = 1 then concat('https://WWW.d', cast(k % 211 as string), '.example/about') when k % 5 = 2 then concat('send.d', cast(k % 97 as string), '.example') else concat('d', cast(k as string), '.co.uk') end as domain,
 case when k % 4 = 0 then concat('http://www.s', cast(k % 301 as string), '.example:8080/x?y=1') when k % 4 = 1 then concat('d', cast(k % 97 as string), '.example/path') end as website,
 case when k % 9 = 0 then concat('alt', cast(k % 40 as string), '.example; Shop.alt', cast(k % 40 as string), '.example, nodot') end as additional_domains,
 case when k % 7 = 0 then concat('https://www.linkedin.com/', case when k % 2 = 0 then 'company' else 'school' end, '/Long-Slug-', cast(k % 203 as string), '/about?x=1') when k % 7 = 1 then 'linkedin.com/company/short' end as linkedin_url,
 case when k % 3 = 0 then concat('+1 (617) 555-', lpad(cast(k % 89 as string),4,'0')) when k % 3 = 1 then concat('44 20 7946 ', lpad(cast(k as string),4,'0')) else '555-01' end as phone,
 split_part('boston,NEW YORK, st. john''s,Lyon,san josé',',',cast(k % 4 + 1 as int)) as city,
 split_part('MA,ny,Ontario,tx,new hampshire,',',',cast(k % 6 + 1 as int)) as state,
 case when k % 2 = 0 then ' united states ' else 'FRANCE' end as country,
 split_part('Retail,Retail Trade,Mining,Health Care,Software',',',cast((k * 3) % 5 + 1 as int)) as industry,
 cast((k * 37) % 900 as bigint) as employee_count,
 split_part('customer,opportunity,lead,subscriber,other',',',cast(k % 5 + 1 as int)) as lifecycle_stage,
 case when k % 6 = 0 then 'open' end as lead_status, case when k % 4 = 0 then ' unassigned ' when k % 4 = 1 then 'o1' end as owner_id,
 case when k % 3 = 0 then concat('2024-01-',lpad(cast(k % 28 + 1 as string),2,'0'),'T05:00:00Z') when k % 3 = 1 then 'garbage' end as last_activity_date,
 case when k % 5 = 0 then '2022-06-01T00:00:00Z' end as last_modified_date,
 cast(k % 31 as bigint) as num_associated_contacts, cast(k % 3 as bigint) as num_associated_deals
from (select c_custkey as k,
  split_part('Acme,Borealis,Cobalt,Dynamo,Ember,Falcon,Granite,Harbor,Indigo,Juniper,Kestrel,Lumen,Meridian,Nimbus,Orchid,Pioneer,Quartz,Raven,Summit,Tundra,University,Vertex,Willow,Xenon,Yarrow,Zephyr,North,Acmes,Cobalts,Embers',',',cast((c_custkey * 7) % 30 + 1 as int)) as word
 from customer)"""

ALL = {"fx_pages": (PAGES, "pages"), "fx_part": (PARTS, "part"), "fx_contacts": (CONTACTS, "customer"), "fx_companies": (COMPANIES, "customer")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, table = ALL[name]
    return spark.sql(sql.replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
