"""Components of all matches from links that grow with the records, not with the square of a key's.

Rows of an exact key are linked to its smallest id. Rows that must also have similar names are linked so
where the names are equal; different names of a key are compared only where
the components so far leave more than one in the key: first names that are neighbours in their order, then
the names outside of a key's largest component with all others. A rule's pair has the smaller id first: two classes of rows are linked if a row of the first has a
smaller id than one of the second. Candidates that a rule matches too are linked either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import storage
from ..functions import similarity as s, text as t
from ..schema import Settings
from . import matching as m
from .bounded import LETTERS, common_letters, equal_beginning, highest, spread
from .components import connected_components


def stars(keys: DataFrame, *key: str) -> DataFrame:
    """id1 and id2: each row of a key (columns ``key``) with the smallest id of the key."""
    first = keys.groupBy(*key).agg(F.min("id").alias("id1"))
    same = reduce(lambda a, b: a & b, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key))
    return keys.alias("x").join(first.alias("y"), same).select("y.id1", F.col("x.id").alias("id2"))


def classes_of(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """key, name, mail and component of the keys that more than one component has, with the smallest and greatest id of each class."""
    rows = keys.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    found = rows.join(several, "key", "left_semi").groupBy("key", "name", "mail", "component").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return storage.saved(found.withColumn("lower", F.lower("name")).withColumn("letters", spread(F.col("lower"), LETTERS)), "classes")


def joined(pairs: DataFrame, least: float) -> DataFrame:
    """src and dst of the pairs of classes (columns with 1 and 2) of different components that a pair of their rows joins."""
    c = F.col
    bound = highest(common_letters("letters1", "letters2", len(LETTERS) + 1), F.length("lower1"), F.length("lower2"), equal_beginning(c("lower1"), c("lower2")))
    some = pairs.where("component1 <> component2 and coalesce(mail1 = mail2, true) and (low1 < high2 or low2 < high1)").where(bound >= least)
    some = some.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name1", "name2")
    either = F.when((c("low1") < c("high2")) & (s.jaro_winkler(c("name1"), c("name2")) >= least), True).otherwise((c("low2") < c("high1")) & (s.jaro_winkler(c("name2"), c("name1")) >= least))
    return some.where(either).select(c("component1").alias("src"), c("component2").alias("dst")).distinct()


COLUMNS = ("name", "mail", "component", "low", "high", "lower", "letters")


def neighbours(keys: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links of classes that are next to each other in the order of a key's names: few, and most of what there is."""
    w = Window.partitionBy("key").orderBy("lower", "name", "mail", "component")
    one, other = [F.col(c).alias(f"{c}1") for c in COLUMNS], [F.lag(c).over(w).alias(f"{c}2") for c in COLUMNS]
    return joined(classes_of(keys, labels).select("key", *one, *other).where("component2 is not null"), least)


def between(keys: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links of all classes of a key: those outside of the component that most of them have meet all others."""
    classes = classes_of(keys, labels)
    most = classes.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    classes = classes.join(most, "key")
    side = lambda i: classes.select("key", "main", *(F.col(c).alias(f"{c}{i}") for c in COLUMNS))
    pairs = side(1).where("component1 <> main").join(side(2).drop("main"), "key").where("component2 = main or component1 < component2")
    return joined(pairs, least)


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links (src, dst) of components; a record that had no component is one by itself."""
    links = storage.saved(links, "links")
    if links.isEmpty():
        return labels
    further = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("further"))
    alone = further.join(labels.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), "component")
    return storage.saved(labels.unionByName(alone).join(further, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "labels")


def rule_links(kind: str, rows: DataFrame, pages: DataFrame | None = None) -> tuple[list[DataFrame], list[tuple[DataFrame, float]]]:
    """Links of exact keys, and keys (key, name, mail, id) with the least similarity of their names."""
    none: Column = F.lit(None).cast("string")
    if kind == "company":
        domains = rows.select(F.explode("all_domains").alias("key"), F.col("record_id").alias("id"))
        phones = m.keyed(rows, F.col("phone"), "name")
        named = [(m.root_keys(rows).withColumn("mail", none), 0.75), (phones.withColumn("mail", none), 0.75)]
        return [stars(domains, "key"), stars(m.gate_linkedin(rows) if pages is None else pages, "key")], named
    keys = m.keyed(rows, m.name_domain(), "name", "email")
    mail = F.when(F.col("email").isNotNull(), t.email_domain(F.col("email")))
    return [stars(m.keyed(rows, F.col(c)), "key") for c in ("email", "linkedin_url")], [(keys.select("key", "name", mail.alias("mail"), "id"), 0.85)]


def match_components(kind: str, rows: DataFrame, settings: Settings, probable: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """node and component of all records with a match: the same as of all pairs of ``find_matches``.

    Where rows are a part of all, ``probable`` has the pairs (id1, id2) that the name blocks gave and ``pages`` what ``gate_linkedin``
    gave, since these depend on all records of a key."""
    exact, named = rule_links(kind, rows, pages)
    named = [(keys.where("name <> ''"), least) for keys, least in named]
    if probable is None:
        probable = (m.probabilistic_company if kind == "company" else m.probabilistic_contact)(rows, m.candidates_by_name(rows, settings), settings)
    links = exact + [stars(keys, "key", "name", "mail") for keys, _ in named] + [probable.select("id1", "id2")]
    every = reduce(DataFrame.union, links).where("id1 <> id2").select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    labels = connected_components(every)
    for found in (neighbours, between):
        labels = contracted(labels, reduce(DataFrame.union, (found(keys, labels, least) for keys, least in named)))
    return labels
