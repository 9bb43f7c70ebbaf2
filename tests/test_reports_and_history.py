"""Pages, merges that are undone, and reports from sketches, against plain steps."""

import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from kindred.operators import cursors, history
from kindred.operators.components import relabelled
from kindred.plans import reports


@pytest.mark.parametrize("ways", [("ASCENDING", "DESCENDING"), ("DESCENDING", "ASCENDING"), ("DESCENDING", "DESCENDING")])
def test_pages_give_every_row_once(spark, ways):
    r = random.Random(5)
    rows = [(i, r.choice([None, "a", "b", "bé", ""]), r.choice([None, -1.5, 0.0, 2.25, float("nan")]), i % 3) for i in range(57)]
    table = spark.createDataFrame(rows, "id long, s string, v double, extra int").repartition(4).cache()
    sorts, groups = [("s", ways[0]), ("v", ways[1])], [[{"propertyName": "extra", "operator": "NEQ", "value": 1}]]

    def compare(a, b):
        for x, y, way in ((a[1], b[1], ways[0]), (a[2], b[2], ways[1]), (a[0], b[0], "ASCENDING")):
            rank = lambda z: (0, 0) if z is None else (2, 0) if z != z else (1, z.encode() if isinstance(z, str) else z)
            if rank(x) != rank(y):
                return (1 if rank(x) > rank(y) else -1) * (1 if way == "ASCENDING" else -1)
        return 0

    want = [x[0] for x in sorted((x for x in rows if x[3] != 1), key=cmp_to_key(compare))]
    got, token, tokens = [], None, set()
    while True:
        some, token = cursors.page(table, "id", 10, token, ["id"], groups, sorts)
        got += [x.id for x in some]
        if token is None:
            break
        assert len(some) == 10 and token not in tokens
        tokens.add(token)
    assert got == want
    whole = cursors.all_pages(table, "id", 10, ["id"], groups, sorts).collect()
    assert [x.id for x in sorted(whole, key=lambda x: (x.page, x.nth))] == want
    assert {(x.page, x.after) for x in whole} == {(p + 1, want[p * 10 - 1] if p else None) for p in range((len(want) + 9) // 10)}


def test_pages_stay_right_when_rows_are_added(spark):
    first = spark.range(0, 40, 2)
    some, token = cursors.page(first, "id", 5)
    more, token = cursors.page(first.union(spark.range(1, 40, 2)), "id", 5, token)
    assert [r.id for r in some] == [0, 2, 4, 6, 8] and [r.id for r in more] == [9, 10, 11, 12, 13]
    assert cursors.page(first.limit(0), "id") == ([], None) and cursors.page(first, "id", 500)[1] is None and cursors.all_pages(first.limit(0), "id").collect() == []
    plan = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(cursors.place_after([("o_orderkey", "ASCENDING")], [F.lit(7)]))
    assert "GreaterThan(o_orderkey,7)" in plan._jdf.queryExecution().executedPlan().toString()
    for token in ("x", cursors.base64.urlsafe_b64encode(b'["1", "2"]').decode()):
        with pytest.raises(ValueError):
            cursors.page(first, "id", 5, token)
    with pytest.raises(ValueError):
        cursors.page(first, "id", 0)


def plain_components(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_undone_merges_by_brute_force(spark):
    r, log = random.Random(8), []
    for seq in range(1, 61):
        merges = [x for x in log if x[1] == "merge"]
        if seq < 20 or r.random() < 0.4:
            log.append((seq, "merge", f"r{r.randrange(25)}", f"r{r.randrange(25)}", None))
        else:
            log.append((seq, r.choice(["undo", "undo", "redo"]), None, None, r.choice([*(m[0] for m in merges), 999])))
    table = spark.createDataFrame(log, history.LOG).repartition(3).cache()

    def force(upto):
        state = {}
        for seq, action, a, b, target in log[:upto]:
            if action == "merge":
                state[seq] = (a, b)
            elif target in state:
                state[target] = (*state[target][:2], action == "undo")
        return [e[:2] for e in state.values() if not (len(e) == 3 and e[2])]

    labels, seen = history.components_at(table, 19), 19
    for upto in (33, 47, 60):
        labels = history.advanced(labels, table, seen, upto)
        want = plain_components(force(upto))
        got = {x.node: x.component for x in labels.collect()}
        assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v} and set(got) == set(want)
        assert got == {x.node: x.component for x in history.components_at(table, upto).collect()}
        seen = upto
    records = spark.createDataFrame([(f"r{i}", i % 4 / 4 if i % 5 else None, "x") for i in range(26)], "record_id string, survivor_score double, name string")
    after = {x.record_id: (x.survivor, x.merged) for x in history.table_at(records, labels).collect()}
    groups = {}
    for node, component in got.items():
        groups.setdefault(component, []).append(node)
    score = {f"r{i}": i % 4 / 4 if i % 5 else -1 for i in range(26)}
    best = {c: min(g, key=lambda x: (-score[x], x)) for c, g in groups.items()}
    assert after == {x: ((s := best[got[x]] if x in got else x), s != x) for x in score}
    undone = table.union(table.where("action = 'merge'").select(F.col("seq") + 1000, F.lit("undo"), F.lit(None), F.lit(None), "seq"))
    assert history.in_force(undone).count() == 0 and not any(x.merged for x in history.table_at(records, history.advanced(labels, undone, 60)).collect())
    assert relabelled(labels.limit(0), None, history.in_force(table).limit(0)).collect() == []


def test_matches_become_a_log(spark):
    matches = spark.createDataFrame([("b", "c", 1), ("a", "b", 2), ("a", "b", 3)], "id1 string, id2 string, x int")
    assert [tuple(r) for r in history.log_of(matches, 5).orderBy("seq").collect()] == [(5, "merge", "a", "b", None), (6, "merge", "b", "c", None)]


def test_cube_from_merged_sketches(spark):
    r = random.Random(2)
    rows = [(f"a{r.randrange(20000)}", f"b{r.randrange(9000)}", r.choice(["company", "contact"]), r.choice(["hot"] * 5 + ["x", None]), r.random() if r.random() < 0.9 else None, r.randrange(4)) for _ in range(30000)]
    matches = spark.createDataFrame(rows, "id1 string, id2 string, kind string, domain string, confidence_score double, batch int").repartition(8)
    found = reports.cube(reports.summarised(matches, ["batch", "kind", "domain"]), ["kind", "domain"]).collect()
    groups = {}
    for a, b, kind, domain, score, _ in rows:
        for level, key in ((0, (kind, domain)), (1, (kind, None)), (2, (None, domain)), (3, (None, None))):
            ids, scores, n = groups.setdefault((level, *key), [set(), [], [0]])
            ids |= {a, b}
            scores += [score] if score is not None else []
            n[0] += 1
    assert {(x.level, x.kind, x.domain) for x in found} == set(groups)
    for x in found:
        ids, scores, n = groups[x.level, x.kind, x.domain]
        assert x.n_matches == n[0] and abs(x.mean_score - sum(scores) / len(scores)) < 1e-9
        assert abs(x.n_records / len(ids) - 1) < 4 * 1.04 / 2 ** (reports.LOG_SIZE / 2)
        for p in (1, 2, 3):
            assert abs(sum(s <= x[f"score_q{p}"] for s in scores) / len(scores) - p / 4) < 0.02
    none = reports.cube(reports.summarised(matches.limit(3).withColumn("confidence_score", F.lit(None).cast("double")), ["kind"]), ["kind"]).collect()
    assert all(x.mean_score is None and x.score_q1 is None for x in none)
    assert reports.summarised(matches.limit(0), ["kind"]).collect() == []
