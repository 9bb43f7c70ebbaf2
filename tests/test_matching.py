"""Rules, gates, clusters, reports and files over small made-up records."""

import json

import pytest
from pyspark.sql import functions as F

from kindred import storage
from kindred.operators import entities, filters, matching as m
from kindred.operators.components import connected_components
from kindred.plans import catalog, pipeline
from kindred.schema import company_settings, contact_settings
from kindred.sources import export, records

AS_OF = "2024-02-01T00:00:00Z"
SF = "/root/testdata/sf0.001"


def companies(spark, *rows):
    return entities.normalize_company(spark.createDataFrame([{"record_id": str(i)} | r for i, r in enumerate(rows)], "record_id string, name string, domain string, website string, linkedin_url string, phone string, city string, state string, country string, industry string, employee_count long, additional_domains string"))


def pairs(df):
    return {(r.id1, r.id2) for r in df.collect()}


def test_domain_and_root_rules(spark):
    rows = companies(spark, {"name": "Foo Works", "domain": "foo.example"}, {"name": "Foo Work", "domain": "send.foo.example"}, {"name": "Bar", "additional_domains": "foo.example; x"}, {"name": "Foo Works", "domain": "a.nhs.uk"}, {"name": "Foo Works", "domain": "b.nhs.uk"})
    assert pairs(m.det_company_domain(rows)) == {("0", "2")}
    assert pairs(m.det_company_root(rows)) == {("0", "1")}
    found = {(r.id1, r.id2): r.rule_rank for r in pipeline.deterministic("company", rows).collect()}
    assert found == {("0", "2"): 1, ("0", "1"): 2}


def test_star_links_have_the_same_components(spark):
    rows = companies(spark, *({"name": f"n{i}", "domain": f"d{i % 3}.example", "additional_domains": "d0.example" if i == 4 else None} for i in range(12)))
    comp = lambda df: {(r.node, r.component) for r in connected_components(df.select(F.col("id1").alias("src"), F.col("id2").alias("dst"))).collect()}
    full, star = m.det_company_domain(rows), m.det_company_domain(rows, star=True)
    assert comp(full) == comp(star) and star.count() < full.count()


def test_linkedin_and_phone_rules(spark):
    link = "linkedin.com/company/{}"
    rows = companies(
        spark, {"linkedin_url": link.format("long-enough-1"), "name": "A b", "phone": "617 555 0100"}, {"linkedin_url": link.format("long-enough-1"), "name": "Q", "phone": "6175550100"}, {"linkedin_url": link.format("short"), "name": "A bb", "phone": "+1 617 555 0100"}, {"linkedin_url": link.format("short")},
        *({"linkedin_url": link.format("many-of-these")} for _ in range(5)),
    )
    assert pairs(m.det_company_linkedin(rows)) == {("0", "1")}
    assert pairs(m.det_company_phone(rows)) == {("0", "2")}


def contacts(spark, *rows):
    return entities.normalize_contact(spark.createDataFrame([{"record_id": str(i)} | r for i, r in enumerate(rows)], "record_id string, email string, first_name string, last_name string, company_name string, job_title string, website string"))


def test_contact_rules(spark):
    rows = contacts(
        spark, {"first_name": "Ann", "last_name": "Lee", "email": "ann@x.example"}, {"first_name": "Ann", "last_name": "Lee", "email": "alee@x.example"}, {"first_name": "ann", "last_name": "lee", "website": "x.example"},
        {"first_name": "Ann", "last_name": "Lee", "email": "ann@y.example", "website": "x.example"}, {"first_name": "Z", "last_name": "Z", "email": "ANN@x.example "},
    )
    assert pairs(m.det_contact_email(rows)) == {("0", "4")}
    assert pairs(m.det_contact_name_domain(rows)) == {("0", "1"), ("0", "2"), ("1", "2"), ("2", "3")}


def test_gates(spark):
    rows = spark.createDataFrame([("University of A", "University of B", "X", "X", 0.93), ("Foo", "Foo", "X", "Y", 1.0), ("Foo", "Fou", "X", "Y", 0.94), ("Foo", "Fou", None, "Y", 0.86), ("Foo", "Fuu", None, None, 0.84)], "name1 string, name2 string, state1 string, state2 string, name_sim double")
    assert [r.name_sim for r in m.gate_company(rows, company_settings()).orderBy("name_sim").collect()] == [0.86, 1.0]


def test_job_changers(spark):
    rows = contacts(spark, {"first_name": "Ann", "last_name": "Lee", "email": "a@x.example"}, {"first_name": "Ann", "last_name": "Lee", "email": "a@y.example"}, {"first_name": "Anita", "last_name": "Leeds", "email": "a@z.example"})
    found = m.probabilistic_contact(rows, m.cand_all_pairs(rows), contact_settings()).collect()
    assert [(r.id1, r.id2, r.confidence_score, r.match_type) for r in found] == [("0", "1", 0.85, "probabilistic_medium")]


def test_settings_need_all_weights():
    with pytest.raises(ValueError):
        company_settings(similarity_weights={"name": 1.0})


def test_candidates_at_the_caps_of_the_method(spark):
    from kindred.plans import catalog

    d = "/root/testdata/sf0.01"
    sizes = [r[0] for r in catalog.part_blocks(spark, d).where("block_key is not null").groupBy("block_key").count().select("count").collect()]
    for name, cap in (("cand_blocked_company", 150), ("cand_blocked_contact", 100)):
        assert catalog.QUERIES[name](spark, d).count() == sum(n * (n - 1) // 2 for n in (min(n, cap) for n in sizes)) > 5320
    rows = spark.createDataFrame([(f"{i:03}", "k") for i in range(200)] + [("x", None)], "record_id string, block_key string")
    assert m.cand_blocked(rows, None).count() == 200 * 199 // 2
    assert m.candidates(rows, company_settings(block_cap=None)).count() == 200 * 199 // 2


def test_block_cap_and_candidates(spark):
    rows = companies(spark, *({"name": f"Same {i:02}"} for i in range(40)))
    assert m.block_cap(rows, 10).count() == 10
    assert len(pairs(m.candidates(rows, company_settings(block_cap=10)))) == 45
    assert len(pairs(m.candidates(rows.limit(20), company_settings()))) == 190


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200), (None, 5)]
    found = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)} | {(200, 200)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_numbers_have_no_gaps(spark):
    found = storage.numbered(spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("x")), "x").collect()
    assert sorted((r.nth, r.x) for r in found) == [(i + 1, i) for i in range(1000)]


def test_whole_run_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Foo Inc", "foo.example"), ("2", "Foo", "foo.example"), ("3", "Bar", None), ("3", "Bar", None), (None, "x", None), ("", "y", None)], "record_id string, name string, domain string")
    result = pipeline.deduplicate(rows, "company", AS_OF)
    assert result.entities.count() == 3
    s = pipeline.summary(result).first()
    assert (s.total_entities, s.total_matches, s.total_clusters, s.duplicates_to_remove) == (3, 1, 1, 1)
    assert {r.match_type: r.n_matches for r in pipeline.match_breakdown(result.matches).collect()} == {"deterministic_high": 1, "deterministic_medium": 0, "probabilistic_high": 0, "probabilistic_medium": 0}
    doc = json.loads(export.report_document(result, AS_OF))
    assert doc["clusters"] == {"cluster_1": ["1", "2"]} and doc["matches"][0]["company_1_phone"] == "—" and set(doc["companies"]) == {"1", "2"}
    export.sink_json_report(result, f"{tmp_path}/report", AS_OF)
    export.sink_csv_matches(result, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert len(back.columns) == 14 and back.count() == 1 and spark.read.json(f"{tmp_path}/report/matches").count() == 1
    nothing = pipeline.deduplicate(rows.where("false"), "contact", AS_OF)
    assert pipeline.summary(nothing).first().deduplication_rate == 0


def test_printed_summary(spark, capsys):
    rows = spark.createDataFrame([("1", "Foo Inc", "foo.example"), ("2", "Foo", "foo.example"), ("3", "Bar", None)], "record_id string, name string, domain string")
    export.sink_stdout_summary(pipeline.deduplicate(rows, "company", AS_OF))
    shown = capsys.readouterr().out
    assert "duplicates_to_remove" in shown and "Shared domain: foo.example" in shown
    assert "deterministic_high" in shown and "probabilistic_high" not in shown  # types without matches are left out


def test_gates_inside_of_rules(spark):
    keys = spark.createDataFrame([("nhs.uk", "1"), ("t.co", "2"), ("foo.example", "3"), ("t.com", "4")], "key string, id string")
    assert {r.id for r in m.gate_generic_root(keys).collect()} == {"3", "4"}
    pages = [("1", "x/long-slug-1"), ("2", "x/long-slug-1"), ("3", "x/long-slug-2"), ("4", "x/short"), ("5", "x/short"), *((str(i), "x/long-slug-3") for i in range(6, 11)), ("11", None)]
    assert {r.id for r in m.gate_linkedin(spark.createDataFrame(pages, "record_id string, linkedin_url string")).collect()} == {"1", "2"}
    mails = [("a", "b", "x@a.example", "y@b.example"), ("a", "c", "x@a.example", "z@a.example"), ("a", "d", "x@a.example", None), ("d", "e", None, None)]
    assert pairs(m.gate_email_conflict(spark.createDataFrame(mails, "id1 string, id2 string, email1 string, email2 string"))) == {("a", "c"), ("a", "d"), ("d", "e")}


def test_personal_domains(spark):
    rows = spark.createDataFrame([("1", "a@gmail.com"), ("2", "b@foo.example")], "record_id string, email string")
    domains = lambda strict: {r.record_id: r.company_domain for r in entities.normalize_contact(rows, strict).collect()}
    assert domains(False) == {"1": "gmail.com", "2": "foo.example"} and domains(True) == {"1": None, "2": "foo.example"}


def test_paths():
    assert export.output_paths("x.csv") == ("x.json", "x.csv.csv") and export.output_paths("x.json") == ("x.json.json", "x.csv") and export.output_paths("x") == ("x.json", "x.csv")


def test_csv_reader(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Record ID,Company name,name,Number of Employees,Phone Number,odd\n1,"A, B",,12.7,617 555 0100,z\n2,NA,C,x,,\n,D,N/A,inf,,q\n')
    found = records.scan_csv_company(spark, f"{tmp_path}/c.csv").orderBy("position").collect()
    assert [(r.record_id, r.name, r.employee_count) for r in found] == [("1", "A, B", 12), ("2", "C", None), ("2", "D", None)]
    assert found[0].raw_data == {"odd": "z"} and found[1].raw_data == {}


@pytest.mark.parametrize("text, ids", [
    ('{"results": [{"id": 5, "properties": {"email": "a@b.c", "firstname": " "}}, {"id": "6", "properties": {"hs_object_id": "x"}}]}', ["5", "x"]),
    ('[{"id": "1", "email": "a"}, {"email": "b"}]', ["1"]), ('{"id": "9", "email": "a", "extra": "y"}', ["9"]),
])
def test_json_reader(spark, tmp_path, text, ids):
    (tmp_path / "c.json").write_text(text)
    found = records.scan_json_contact(spark, f"{tmp_path}/c.json").orderBy("position").collect()
    assert [r.record_id for r in found] == ids and all(r.first_name is None for r in found)


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a@x.example", 5.0), (2, None, None), (3, "b@y.example", 7.0)], "id int, email string, v double")
    ids = lambda *groups: [r.id for r in filters.filter_groups(rows, list(groups)).orderBy("id").collect()]
    f = lambda n, op, v=None: {"propertyName": n, "operator": op, "value": v}
    assert ids([f("email", "CONTAINS_TOKEN", "*@x.example")]) == [1] and ids([f("v", "NEQ", 5.0)]) == [3]
    assert ids([f("email", "NOT_HAS_PROPERTY")], [f("v", "GTE", 6.0), f("email", "HAS_PROPERTY")]) == [2, 3] and ids() == [1, 2, 3]
    assert filters.search(spark.range(500), 400).count() == 100
    with pytest.raises(ValueError):
        filters.condition("v", "LIKE", 1)


def test_queries_run_and_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("customer", "lineitem", "orders", "pages", "part"):
        con.sql(f"create view {table} as from '{SF}/{table}.parquet'")
    for name in ("norm_domain", "normalize_contact", "score_company", "dedup_companies", "scan_json_company", "row_to_record", "gate_generic_root", "gate_linkedin", "gate_email_conflict", "api_pages", "undo_merges", "report_cube"):
        got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
