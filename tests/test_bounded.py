"""Similar names in blocks without a cap, against all pairs."""

import random

from pyspark.sql import functions as F

from kindred.operators import bounded, matching as m
from kindred.plans import catalog
from kindred.schema import company_settings

from .test_functions import plain_jaro_winkler

SF = "/root/testdata/sf0.01"


def names(n, seed=1):
    r = random.Random(seed)
    made = ["acme" + "".join(r.choices("abcdeinorst -É1", k=r.randrange(0, 30))) for _ in range(n)]
    return made + [x.title() for x in made[:10]] + [x + "s" for x in made[:20]] + ["acme", "ACME", "", None]


def test_no_pair_is_lost(spark):
    rows = [(f"{i:04}", "acme" if i % 7 else "other", x) for i, x in enumerate(names(150))] + [("x", None, "acme"), ("y", "acme", "acme"), ("z", "acme", "acme")]
    df = spark.createDataFrame(rows, "record_id string, block_key string, name string")
    for least in (0.75, 0.85, 0.95):
        found = {(r.id1, r.id2): r.name_sim for r in bounded.cand_bounded(df, least).collect()}
        want = {(a[0], b[0]): s for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1] and (s := plain_jaro_winkler(a[2], b[2])) >= least}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_pairs_of_one_name_are_dealt_over_tasks(spark, monkeypatch, tmp_path):
    # one small file: its pairs are many, its rows are not
    spark.range(3000).select(F.col("id").cast("string").alias("record_id"), F.lit("acme").alias("block_key"), F.lit("Acme Foods").alias("name")).coalesce(1).write.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(bounded, "PIECE", 500, raising=False)
    found = bounded.cand_bounded(spark.read.parquet(str(tmp_path / "rows")), 0.85)
    tasks = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == found.distinct().count() == 3000 * 2999 // 2 and max(tasks) < sum(tasks) / 2


def test_few_pairs_are_compared(spark):
    rows = catalog.part_blocks(spark, SF).join(catalog.load(spark, SF, "fx_part").select("record_id", "name"), "record_id")
    pairs = sum(n * (n - 1) // 2 for (n,) in rows.where("block_key is not null").groupBy("block_key").count().select("count").collect())
    assert 0 < bounded.promising(rows.select(F.col("block_key").alias("key"), "name"), 0.85).count() < pairs / 10
    different = spark.createDataFrame([("k", x) for x in names(400, 2) if x], "key string, name string")
    every = different.distinct().count()
    assert bounded.promising(different, 0.95).count() < every * (every - 1) / 10


def test_candidates_by_name_are_those_of_all_pairs(spark):
    rows = spark.createDataFrame([(f"{i:04}", "acme", x) for i, x in enumerate(names(60, 3))], "record_id string, block_key string, name string")
    for settings in (company_settings(), company_settings(block_cap=40), company_settings(block_cap=None), company_settings(use_blocking=False)):
        pairs = m.with_name_sim(m.both_sides(m.candidates(rows, settings), rows, ["name"])).where(F.col("name_sim") >= settings.min_name_similarity)
        found = {(r.id1, r.id2): round(r.name_sim, 9) for r in m.candidates_by_name(rows, settings).collect()}
        assert found and found == {(r.id1, r.id2): round(r.name_sim, 9) for r in pairs.collect()}


def test_bounds_of_similarity(spark):
    r = random.Random(6)
    pairs = [("".join(r.choices("abcE ", k=r.randrange(1, 9))), "".join(r.choices("abce ", k=r.randrange(1, 9)))) for _ in range(500)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({f"{k}{x}": e for x in "ab" for k, e in (("l", F.lower(x)), ("n", F.length(x)))})
    df = df.withColumns({f"{k}{x}": bounded.spread(F.col(f"l{x}"), c) for x in "ab" for k, c in (("fine", bounded.LETTERS), ("rough", bounded.CLASSES))})
    fine = bounded.highest(bounded.common_letters("finea", "fineb", len(bounded.LETTERS) + 1), F.col("na"), F.col("nb"), bounded.equal_beginning(F.col("la"), F.col("lb")))
    rough = bounded.highest(bounded.common_letters("rougha", "roughb", len(bounded.CLASSES) + 1), F.col("na"), F.col("nb"), 4)
    for x in df.select("a", "b", fine.alias("fine"), rough.alias("rough")).collect():
        assert plain_jaro_winkler(x.a, x.b) <= x.fine <= x.rough + 1e-9 or x.a == x.b
