"""Batches against whole runs, golden records and as-of joins against plain steps."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import matching
from kindred.operators.asof import asof_join
from kindred.operators.golden import golden_records, merged
from kindred.operators.sessions import activity, sessions, tumbling
from kindred.plans import incremental, pipeline
from kindred.schema import company_settings

AS_OF = "2024-02-01T00:00:00Z"
LINK = "linkedin.com/company/long-enough-{}"
COMPANY = "record_id string, name string, domain string, linkedin_url string, phone string, last_activity_date string"


def test_batches_give_the_whole_run(spark):
    first = [(f"a{i}", f"Acme {i % 4} Works", f"d{i % 5}.example" if i % 3 else None, LINK.format(i % 6), None, None) for i in range(14)]
    # the fifth record of a link takes its pairs away; a13 changes its domain and a2 its name; others are new
    second = [*((f"b{i}", f"Acme {i % 4} Work", None, LINK.format(0), "617 555 0100", None) for i in range(4)), ("a13", "Zeta", "alone.example", None, None, "2024-01-05T00:00:00Z"), ("a2", "Other Name", "d2.example", None, None, None)]
    frame = lambda rows: spark.createDataFrame(rows, COMPANY)
    settings = company_settings(blocking_min_candidates=0, block_cap=6)
    state = incremental.start("company", frame(first), AS_OF, settings)
    last = dict((r[0], r) for r in [*first, *second])
    for rows, given in ((first, None), (list(last.values()), second)):
        if given:
            state = incremental.add(state, frame(given), AS_OF)
        whole = pipeline.deduplicate(frame(rows), "company", AS_OF, settings)
        shown = lambda df: sorted((r.id1, r.id2, r.match_type, round(r.confidence_score, 9), r.matching_fields, r.explanation, r.survivor, r.action) for r in df.collect())
        assert shown(state.matches) == shown(whole.matches)
        clusters = lambda run: sorted(tuple(r.members) for r in run.clusters.collect())
        assert clusters(state.result()) == clusters(whole) and state.entities.count() == len(rows)
    assert shown(whole.matches) and any("LinkedIn" in x[5] for x in shown(whole.matches))
    with pytest.raises(ValueError):
        incremental.start("company", frame(first), AS_OF, company_settings(use_blocking=False))


def test_components_of_batches_come_without_the_pairs_of_their_keys(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("all pairs of a key were made")

    monkeypatch.setattr(matching, "pairs_of", pairs)
    monkeypatch.setattr(matching, "named_pairs_of", pairs)
    frame = lambda rows: spark.createDataFrame(rows, "record_id string, first_name string, last_name string, email string")
    state = incremental.start("contact", frame([(f"a{i:03}", "Ann", "Abbot", "ann@x.example") for i in range(200)] + [("z1", "Zoe", "Zuse", "zoe@y.example"), ("z2", "Zoe", "Zuse", "zoe@y.example")]), AS_OF)
    # a000 leaves its component and z3 comes to the other
    state = incremental.add(state, frame([("a000", "Quentin", "Moor", "q@w.example"), ("z3", "Zoe", "Zuse", "zoe@y.example")]), AS_OF)
    assert sorted(map(tuple, state.labels.collect())) == sorted([(f"a{i:03}", "a001") for i in range(1, 200)] + [(x, "z1") for x in ("z1", "z2", "z3")])


def test_golden_records(spark):
    rows = [
        ("1", "Foo", "x", None, 5, 0.5, "2024-01-01T00:00:00Z"), ("2", "Foo Inc", "y", "", 7, 0.9, None), ("3", "Foo Ltd", None, "t", 7, 0.9, "2024-01-03T00:00:00Z"), ("4", None, "x", None, None, 0.1, "bad"),
        ("5", "Bar", None, None, None, 0.2, None), ("6", "Baz", None, None, None, 0.2, None), ("7", "Alone", "z", None, 1, 0.3, None),
    ]
    records = spark.createDataFrame(rows, "record_id string, name string, city string, title string, size int, survivor_score double, last_modified_date string")
    members = spark.createDataFrame([("c1", x) for x in "1234"] + [("c2", "5"), ("c2", "6"), ("c2", "none")], "cluster_id string, record_id string")
    ways = {"name": "longest", "city": "most", "title": "survivor", "size": "greatest", "last_modified_date": "latest"}
    found = {r.cluster_id: r for r in golden_records(members, records, ways).collect()}
    a, b = found["c1"], found["c2"]
    assert (a.n_members, a.name, a.city, a.title, a.size, a.last_modified_date) == (4, "Foo Inc", "x", "t", 7, "2024-01-03T00:00:00Z")
    assert a.sources == {"name": "2", "city": "1", "title": "3", "size": "2", "last_modified_date": "3"}
    assert (b.n_members, b.name, b.city, b.sources) == (2, "Bar", None, {"name": "5"})
    survivors = spark.createDataFrame([("c1", "2"), ("c2", "5")], "cluster_id string, survivor string")
    after = {r.record_id: r for r in merged(records, members, golden_records(members, records, ways), survivors).collect()}
    assert after.keys() == {"2", "5", "7"} and after["2"].title == "t" and after["2"].survivor_score == 0.9 and after["7"].merged_from == ["7"] and after["2"].merged_from == ["1", "2", "3", "4"]
    assert golden_records(members.where("false"), records, ways).collect() == []
    with pytest.raises(ValueError):
        golden_records(members, records, {"name": "best"})


@pytest.mark.parametrize("strict", [False, True])
def test_asof_by_brute_force(spark, strict):
    r = random.Random(7)
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), r.choice([None, *range(0, 4000, 7)])) for i in range(300)] + [(5, "hot", 70)] * 2
    right = [(key(), r.choice([None, *range(0, 3000, 7)]), r.randrange(9)) for _ in range(200)]
    at = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    x, y = at(spark.createDataFrame(left, "n int, k string, t int"), "t"), at(spark.createDataFrame(right, "k string, u int, v int"), "u")
    found = asof_join(x, y, "k", "t", "u", ["v"], span_seconds=100, strict=strict)
    assert found.columns == ["n", "k", "t", "right_time", "v"]
    seconds = lambda c: F.unix_timestamp(c).alias(c)
    got = sorted(map(str, map(tuple, found.select("n", "k", seconds("t"), seconds("right_time"), "v").collect())))
    want = []
    for n, k, t in left:
        fits = [(u, v) for l, u, v in right if l == k and None not in (k, t, u) and (u < t or u == t and not strict)]
        want.append(str((n, k, t, *(max(fits) if fits else (None, None)))))
    assert got == sorted(want)
    assert asof_join(x.where("false"), y, "k", "t", "u", ["v"]).collect() == [] and asof_join(x, y.where("false"), "k", "t", "u", ["v"]).where("v is not null").count() == 0


def test_sessions_and_windows(spark):
    rng, gap = random.Random(3), 60
    events = [(u, rng.randrange(3000), rng.random() < 0.3) for u in ("a", "b", "b") for _ in range(40)] + [("c", 0, True), ("c", 60, None), ("c", 121, False), ("c", 121, False), (None, 5, True), ("d", None, True)]
    rows = spark.createDataFrame(events, "user string, second long, paid boolean").withColumn("ts", F.timestamp_seconds("second")).withColumn("n", F.lit("extra"))
    want = []
    for user in "abc":
        open_ = []
        for _, second, paid in sorted((e for e in events if e[0] == user), key=lambda e: e[1]):
            if not open_ or second - open_[-1][1] > gap:
                open_.append([second, second, 0, 0])
            open_[-1] = [open_[-1][0], second, open_[-1][2] + 1, open_[-1][3] + bool(paid)]
        want += [(user, i, *x) for i, x in enumerate(open_, 1)]
    found = sessions(rows, "user", "ts", gap, {"paid_n": F.col("paid")})
    assert sorted((r.user, r.session, int(r.started.timestamp()), int(r.ended.timestamp()), r.n, r.paid_n) for r in found.collect()) == sorted(want)
    assert [x[4] for x in want if x[0] == "c"] == [2, 2]  # a pause of the gap itself ends nothing
    assert {r.user: r.n_sessions for r in activity(found, "user", AS_OF).collect()} == {u: sum(x[0] == u for x in want) for u in "abc"}
    assert {(r.user, r.n) for r in tumbling(rows.where("user = 'c'"), "user", "ts", "2 minutes").collect()} == {("c", 2)}
    assert sessions(rows.where("false"), "user", "ts", gap).count() == 0
