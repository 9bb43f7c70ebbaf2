"""Pairs of similar names in blocks of any size, without a cap and without the square of a block.

Jaro-Winkler cannot exceed what lengths, common letters and equal beginnings allow: with c
common letters of names of n and m, jaro is at most (c/n + c/m + 1) / 3. A name's
signature has its length and the counts of its letters in a few classes. Names are
compared once, however many records have them; signatures of a block that can reach the
least similarity are joined first, then the names with these signatures whose
letters one by one still can, and only they are evaluated. Records meet
through the names that are similar, so that the work on records follows the number of pairs found.

All of it is equi-joins on a block, a signature or a name. A block with a third of all records costs
its distinct names; pairs of its signatures are bounded by the signatures that there are. The bound is
on the similarity itself: no pair is lost. Names that are null or empty are similar to nothing.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from .. import storage
from ..functions import similarity as s
from .matching import computed

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Classes of letters, each about as frequent in names as the others.
CLASSES = ("ae", "iou", "nrs", "tlc", "dhmpgb", "fkvwxyzjq", "0123456789 ")
#: Room for rounding in sums of doubles.
ROUNDING = 1e-9


def counts(name: Column, letters: str) -> Column:
    """How many characters of the name are among these letters."""
    return F.length(name) - F.length(F.translate(name, letters, ""))


def highest(common: Column, n: Column, m: Column, beginning: Column | int) -> Column:
    """The most that Jaro-Winkler can be with so many common letters, lengths and equal first characters."""
    jaro = (common / n + common / m + 1) / 3
    return F.when(common == 0, 0.0).otherwise(jaro + 0.1 * F.lit(beginning) * (1 - jaro)) + ROUNDING


def common_letters(one: str, other: str, n: int) -> Column:
    """Common letters of two arrays of counts, the last of which is of all letters that have no count of their own."""
    return reduce(add, (F.least(F.get(one, F.lit(i)), F.get(other, F.lit(i))) for i in range(n)))


def equal_beginning(a: Column, b: Column) -> Column:
    """How many of the first four characters are equal, before the first that differs."""
    out = F.lit(0)
    for k in range(1, 5):
        same = (F.substring(a, 1, k) == F.substring(b, 1, k)) & (F.length(a) >= k) & (F.length(b) >= k)
        out = F.when(same, k).otherwise(out)
    return out


def spread(name: Column, classes) -> Column:
    """Counts of the classes, and of all other characters."""
    some = [counts(name, c) for c in classes]
    return F.array(*some, F.length(name) - reduce(add, some))


def signed(rows: DataFrame) -> DataFrame:
    """key, name, lower, n, letters and sign of each distinct name of a key."""
    names = rows.where("key is not null and name <> ''").select("key", "name").distinct()
    names = names.withColumn("lower", F.lower("name")).withColumn("n", F.length("lower"))
    return names.withColumn("letters", spread(F.col("lower"), LETTERS)).withColumn("sign", spread(F.col("lower"), CLASSES))


def promising(rows: DataFrame, least: float) -> DataFrame:
    """key, name1 and name2: pairs of different names of a key, in both orders, whose letters allow the similarity."""
    names = storage.saved(signed(rows), "names")
    signs = names.select("key", "n", "sign").distinct()
    side = lambda i: signs.select("key", F.col("n").alias(f"n{i}"), F.col("sign").alias(f"sign{i}"))
    allowed = side(1).join(side(2), "key").where(highest(common_letters("sign1", "sign2", len(CLASSES) + 1), F.col("n1"), F.col("n2"), 4) >= least)
    named = lambda i: names.select("key", *(F.col(x).alias(f"{x}{i}") for x in ("name", "lower", "n", "letters", "sign")))
    both = named(1).join(allowed, ["key", "n1", "sign1"]).join(named(2), ["key", "n2", "sign2"]).where("name1 <> name2")
    common = common_letters("letters1", "letters2", len(LETTERS) + 1)
    return both.where(highest(common, F.col("n1"), F.col("n2"), equal_beginning(F.col("lower1"), F.col("lower2"))) >= least).select("key", "name1", "name2")


def similar_meeting(names: DataFrame, least: float) -> DataFrame:
    """name1, name2 and name_sim, in both orders, of the names that meet in a key (key, name; distinct) and reach the similarity,
    and of each name with itself: two names are compared once, however many keys they meet in."""
    from .matching import pairs_of

    signs = names.select("key", F.col("name").alias("id"), F.length(F.lower("name")).alias("n"), spread(F.lower("name"), CLASSES).alias("sign"))
    rough = highest(common_letters("sign1", "sign2", len(CLASSES) + 1), F.col("n1"), F.col("n2"), 4)
    met = pairs_of(signs, "n", "sign").where(rough >= least).select("id1", "id2").distinct()
    both = met.select(F.explode(F.array(*(F.struct(F.col(a).alias("name1"), F.col(b).alias("name2")) for a, b in (("id1", "id2"), ("id2", "id1"))))).alias("p")).select("p.*")
    some = both.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name1", "name2")
    found = computed(some, name_sim=s.jaro_winkler(F.col("name1"), F.col("name2"))).where(F.col("name_sim") >= least)
    same = names.select(F.col("name").alias("name1"), F.col("name").alias("name2"), F.lit(1.0).alias("name_sim")).distinct()
    return storage.saved(found.unionByName(same), "similar")


def similar(rows: DataFrame, least: float) -> DataFrame:
    """key, name1, name2 and name_sim of the pairs of names of a key that reach the similarity, in both orders, and of each name with itself."""
    pairs = promising(rows, least)
    pairs = pairs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name1", "name2")
    found = computed(pairs, name_sim=s.jaro_winkler(F.col("name1"), F.col("name2"))).where(F.col("name_sim") >= least)
    same = rows.where("key is not null and name <> ''").select("key", F.col("name").alias("name1"), F.col("name").alias("name2"), F.lit(1.0).alias("name_sim")).distinct()
    return storage.saved(found.unionByName(same), "similar")


#: Records of a name that are in one piece: pairs of pieces are dealt over all tasks.
PIECE = 1000


def cand_bounded(rows: DataFrame, least: float, decimals: int | None = None) -> DataFrame:
    """id1, id2 and name_sim (to ``decimals``, rounded once for each two names) of all pairs of records (record_id, block_key, name) of a block whose names reach the similarity.

    Of a pair's two orders the one with the smaller id first is compared. Records of a name are cut into pieces, which
    meet those of each similar name and are then dealt over all tasks: the number of tasks follows the number
    of pairs, as neither rows nor names are large enough for Spark to tell."""
    from .matching import TASK_PAIRS

    keyed = rows.select(F.col("block_key").alias("key"), "name", F.col("record_id").alias("id")).where("key is not null and name <> ''")
    names = similar(keyed, least)
    names = names if decimals is None else storage.saved(names.withColumn("name_sim", F.round("name_sim", decimals)), "rounded")
    sizes = keyed.groupBy("key", "name").agg(F.count("*").alias("n")).withColumn("_n", F.ceil(F.col("n") / PIECE).cast("int"))
    sizes = storage.saved(sizes, "sizes")
    several = names.select("key", F.col("name1").alias("name"), "name2").join(sizes, ["key", "name"]).join(sizes.select("key", F.col("name").alias("name2"), F.col("n").alias("n2")), ["key", "name2"])
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((several.agg(F.sum(F.col("n").cast("double") * F.col("n2"))).first()[0] or 0) / TASK_PAIRS))
    cut = keyed.join(sizes.drop("n"), ["key", "name"]).groupBy("key", "name", F.pmod(F.xxhash64("id"), "_n").alias("piece")).agg(F.collect_list("id").alias("ids"))
    cut = storage.saved(cut, "pieces")
    side = lambda i: cut.select("key", F.col("name").alias(f"name{i}"), F.col("piece").alias(f"piece{i}"), F.col("ids").alias(f"ids{i}"))
    met = side(1).join(names, ["key", "name1"]).join(side(2), ["key", "name2"]).repartition(tasks, "key", "name1", "piece1", "name2", "piece2")
    return met.select("ids2", "name_sim", F.explode("ids1").alias("id1")).select("id1", F.explode("ids2").alias("id2"), "name_sim").where("id1 < id2")
