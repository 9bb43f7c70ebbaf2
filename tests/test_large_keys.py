"""Keys that many records share: the same results, without work on the square of a key where the result does not ask for it."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kindred.operators import components, entities, matching as m
from kindred.operators.components import connected_components
from kindred.operators.links import match_components
from kindred.plans import catalog, pipeline
from kindred.schema import company_settings, contact_settings
from kindred.sources import export

AS_OF = "2024-02-01T00:00:00Z"


def companies(spark, n=260, seed=3):
    r = random.Random(seed)
    words = ["Acme", "Acmes", "Ember", "Embers", "North"]
    domain = lambda i: r.choice([None, "a.example", "x.a.example", f"d{r.randrange(30)}.example", f"s.d{r.randrange(30)}.example", "x.nhs.uk", "y.nhs.uk", f"own{i}.example"])
    rows = [(str(i), r.choice([None, *words]) and f"{r.choice(words)} {r.choice(['Foods', 'Labs', 'Mining', 'Media'])}", domain(i), r.choice([None, f"617555{r.randrange(40):04d}"]), r.choice([None, f"linkedin.com/company/long-slug-{r.randrange(60)}"])) for i in range(n)]
    raw = spark.createDataFrame(rows, "record_id string, name string, domain string, phone string, linkedin_url string")
    return entities.with_survivor_score(entities.normalize_company(raw), "company", AS_OF)


def contacts(spark, n=260, seed=4):
    r = random.Random(seed)
    mail = lambda: r.choice([None, f"u{r.randrange(90)}@a.example", f"v{r.randrange(90)}@b.example"])
    rows = [(str(i), r.choice([None, "Ann", "Anna", "Annabel", "Bo"]), r.choice(["Lee", "Leeson", "Abbot"]), mail(), r.choice([None, "http://www.a.example/", "http://c.example"]), r.choice([None, f"linkedin.com/in/u{r.randrange(90)}"])) for i in range(n)]
    raw = spark.createDataFrame(rows, "record_id string, first_name string, last_name string, email string, website string, linkedin_url string")
    return entities.with_survivor_score(entities.normalize_contact(raw), "contact", AS_OF)


KINDS = {"company": (companies, company_settings), "contact": (contacts, contact_settings)}


def ids(df):
    return sorted((r.id1, r.id2) for r in df.select("id1", "id2").collect())


@pytest.mark.parametrize("kind", KINDS)
def test_pairs_asked_one_by_one_are_those_that_all_pairs_of_the_rules_leave(spark, kind):
    make, settings = KINDS[kind]
    rows = make(spark).localCheckpoint()
    rules = pipeline.deterministic(kind, rows).localCheckpoint()
    for pairs in (m.candidates(rows, settings()), m.candidates_by_name(rows, settings())):
        left = ids(m.anti_exclude(pairs, rules))
        assert ids(m.unmatched(kind, pairs, rows)) == left
        assert 0 < len(left) < pairs.count()


def test_a_domain_of_many_records_does_not_bring_their_square_to_the_candidates(spark):
    # 30,000 records of one domain are 450 million pairs, candidates some thousand
    raw = spark.range(30_000).select(F.col("id").cast("string").alias("record_id"), F.concat(F.lit("Acme "), F.col("id") % 9).alias("name"), F.lit("a.example").alias("domain"), F.lit("6175550100").alias("phone"))
    rows = entities.normalize_company(raw).localCheckpoint()
    assert m.unmatched("company", m.candidates(rows, company_settings()), rows).count() == 0


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_links_are_those_of_all_matches(spark, kind, seed):
    make, settings = KINDS[kind]
    rows = make(spark, 120, seed).localCheckpoint()
    every = pipeline.find_matches(kind, rows, settings()).select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    found = sorted(map(tuple, match_components(kind, rows, settings()).select("node", "component").collect()))
    assert found == sorted(map(tuple, connected_components(every).select("node", "component").collect()))


def test_keys_cut_into_pieces_give_each_pair_once(spark, monkeypatch):
    keys = spark.range(40).select(F.when(F.col("id") < 25, "a").otherwise("b").alias("key"), F.col("id").cast("string").alias("id"), (F.col("id") % 4).cast("string").alias("city"))
    monkeypatch.setattr(m, "PIECE", 3)
    pairs = m.pairs_of(keys, "city")
    assert pairs.rdd.getNumPartitions() >= 8
    rows = [("a" if i < 25 else "b", str(i), str(i % 4)) for i in range(40)]
    assert sorted(map(tuple, pairs.select("key", "id1", "id2", "city1", "city2").collect())) == sorted((k, i, j, x, y) for k, i, x in rows for l, j, y in rows if k == l and i < j)
    found = m.with_value_sim(pairs, keys, "city", "sim").select("city1", "city2", "sim").collect()
    assert len(found) == pairs.count() and {r.sim for r in found if r.city1 == r.city2} == {1.0} and {r.sim for r in found if r.city1 != r.city2} == {0.0}


@pytest.mark.parametrize("kind", KINDS)
def test_each_pair_comes_from_its_first_rule_without_a_shuffle_of_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(m, "PIECE_NAMES", 4)
    monkeypatch.setattr(m, "CHUNK", 3)
    rows = KINDS[kind][0](spark, 200, 7).localCheckpoint()
    every = {"company": {1: m.det_company_domain, 2: m.det_company_root, 3: m.det_company_linkedin, 4: m.det_company_phone}, "contact": {1: m.det_contact_email, 2: m.det_contact_linkedin, 3: m.det_contact_name_domain}}[kind]
    rules = {k: f(rows).localCheckpoint() for k, f in every.items()}
    columns = [*m.MATCH, "rule_rank"]
    for ranks in {"company": ((1, 2, 3, 4), (1, 2, 4)), "contact": ((1, 2, 3),)}[kind]:
        found = m.pairs_by_first_rule(kind, rows, "survivor_score", "name", ranks=ranks)
        want = sorted(map(str, m.first_rule(*(rules[k] for k in ranks)).select(*columns).collect()))
        assert sorted(map(str, found.select(*columns).collect())) == want and want
        scores = {r.record_id: (r.survivor_score, r.name) for r in rows.collect()}
        assert all(scores[r.id1] == (r.survivor_score1, r.name1) and scores[r.id2] == (r.survivor_score2, r.name2) for r in found.collect())
    plan = pipeline.find_matches(kind, rows, KINDS[kind][1]())._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[id1" not in plan and "SortAggregate(key=[id1" not in plan and "ObjectHashAggregate(keys=[id1" not in plan


def test_pairs_of_similar_names_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(9)
    names = ["Acme Foods", "Acmes Food", "ACME foods", "Ember Labs", "Embers Lab", "Zq", "", None]
    rows = [(r.choice(["a", "b", None]), f"{i:03}", r.choice(names), i) for i in range(120)]
    keys = spark.createDataFrame(rows, "key string, id string, name string, size int")
    pairs = m.with_name_sim(m.pairs_of(keys, "name", "size")).where("name_sim >= 0.75")
    want = sorted((x.key, x.id1, x.id2, x.name1, x.name2, x.size1, x.size2, round(x.name_sim, 9)) for x in pairs.collect())
    for names_each, chunk in ((500, 2000), (2, 5)):
        monkeypatch.setattr(m, "PIECE_NAMES", names_each)
        monkeypatch.setattr(m, "CHUNK", chunk)
        found = m.named_pairs_of(keys, 0.75, "size")
        assert sorted((x.key, x.id1, x.id2, x.name1, x.name2, x.size1, x.size2, round(x.name_sim, 9)) for x in found.collect()) == want and want
    assert "hashpartitioning(id1" not in found._jdf.queryExecution().executedPlan().toString()


def test_chains_in_the_order_of_their_nodes_meet_in_one_round(spark, monkeypatch):
    # 500 chains of eight, as merges of neighbours are; a round each for two of eight nodes would take six or more
    turns, pointed = [], components.pointed
    monkeypatch.setattr(components, "pointed", lambda edges, turn: turns.append(turn) or pointed(edges, turn))
    edges = spark.range(4000).where("id % 8 <> 0").select(F.format_string("n%05d", F.col("id") - 1).alias("src"), F.format_string("n%05d", F.col("id")).alias("dst"))
    loops = spark.createDataFrame([("alone", "alone"), ("n00003", "n00003")], "src string, dst string")
    found = components.connected_components(edges.union(loops))
    assert turns == [0]
    assert sorted(map(tuple, found.collect())) == sorted([(f"n{i:05d}", f"n{i // 8 * 8:05d}") for i in range(4000)] + [("alone", "alone")])


@pytest.mark.parametrize("name", ["gate_generic_prefix", "gate_location_mismatch", "gate_min_name", "gate_sparse_company"])
def test_gates_keep_no_square_of_a_domain_on_disk(spark, tmp_path, name):
    # 2,500 customers whose domain is d1.example are 3 million pairs, which no gate needs; folders only shrink by themselves
    spark.range(2500).select((1 + 1055 * F.col("id")).alias("c_custkey")).union(spark.range(2, 700).where("id % 1055 <> 1")).write.parquet(str(tmp_path / "customer.parquet"))
    folders = [Path(spark.sparkContext.getConf().get("spark.local.dir")), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))]
    used = lambda: sum(p.stat().st_size for d in folders for p in d.rglob("*") if p.is_file())
    before = used()
    assert len(catalog.QUERIES[name](spark, str(tmp_path)).collect()) > 100
    assert used() - before < 10_000_000


@pytest.mark.parametrize("kind", KINDS)
def test_files_of_matches_take_few_bytes_a_pair(spark, tmp_path, kind):
    # 600 records of one key are 180 thousand pairs; each is 100 to 600 characters as text
    raw = {"company": (F.lit("Acme").alias("name"), F.lit("a.example").alias("domain")), "contact": (F.lit("Ann").alias("first_name"), F.lit("ann@a.example").alias("email"))}[kind]
    result = pipeline.deduplicate(spark.range(600).select(F.col("id").cast("string").alias("record_id"), *raw), kind, AS_OF)
    if kind == "company":
        export.sink_csv_matches(result, str(tmp_path / "out"))
        found = spark.read.option("header", True).csv(str(tmp_path / "out"))
    else:
        export.sink_json_report(result, str(tmp_path / "out"), AS_OF)
        found = spark.read.json(str(tmp_path / "out" / "matches"))
    assert found.count() == 600 * 599 // 2
    assert sum(p.stat().st_size for p in (tmp_path / "out").rglob("*") if p.is_file()) < 20 * 600 * 599 // 2


def test_first_matches_are_found_without_the_square_of_a_domain(spark, monkeypatch):
    # 2,000 records of one domain are two million pairs, of which those of the first hundred records are asked for
    made = []
    for name in ("pairs_of", "named_pairs_of"):
        monkeypatch.setattr(m, name, lambda *a, f=getattr(m, name), **k: made.append(f(*a, **k)) or made[-1])
    raw = spark.range(2000).select(F.col("id").cast("string").alias("record_id"), F.concat(F.lit("Acme "), F.col("id") % 3).alias("name"), F.lit("a.example").alias("domain"))
    found = [(r.Company_1_ID, r.Company_2_ID) for r in pipeline.sample_matches(pipeline.deduplicate(raw, "company", AS_OF)).collect()]
    assert found == [("0", x) for x in sorted(map(str, range(1, 2000)))[:10]]
    assert sum(df.count() for df in made if "key" in df.columns) < 1_000_000
