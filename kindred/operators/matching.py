"""Deterministic rules, candidates and probabilistic matches between entities.

A rule is a self equi-join on a key, kept to id1 < id2; of the rules that match a
pair the first counts. Candidates are the pairs of a name block. All joins shuffle
by key, so that Spark can split skewed ones; nothing is broadcast by hand. Pairs of
one key grow with the square of its rows: that is the result asked for. Where only
clusters are wanted, ``star=True`` links each row of an exact key to its smallest
id instead, which gives the same components from one pair a row.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import storage
from ..functions import similarity as s, text as t
from ..schema import Settings

# Root domains that many organizations share.
GENERIC_ROOTS = ("nhs.uk", "gov.uk", "gc.ca", "gov.au", "qc.ca", "on.ca", "bc.ca", "ab.ca", "edu", "gov", "mil", "org", "harvard.edu", "stanford.edu", "mcgill.ca")
# First words that say little about a company.
GENERIC_PREFIXES = (
    "university", "hospital", "children", "childrens", "baptist", "memorial", "community", "north", "south", "east", "west", "mount", "saint", "regional", "national", "american", "central",
    "general", "medical", "surgical", "texas", "boston", "new", "san", "santa", "med", "advent", "advocate", "northern", "southern", "eastern", "western", "northeast", "northwest", "southeast",
    "southwest", "commonwealth", "methodist", "presbyterian", "lutheran", "catholic", "mercy", "providence", "sacred", "good", "quebec", "ontario",
)

MATCH = ("id1", "id2", "match_type", "confidence_score", "matching_fields", "explanation")


def keyed(rows: DataFrame, key: Column, *also: str) -> DataFrame:
    return rows.select(key.alias("key"), F.col("record_id").alias("id"), *also).where("key is not null").distinct()


#: Rows of a key that meet in one piece; more are cut, and each piece of a key meets each other.
PIECE = 2000
#: Pairs that one task looks at, about.
TASK_PAIRS = 200_000_000


def reached(keys: DataFrame, below: str | None) -> DataFrame:
    """The rows of the keys that have an id up to ``below``; all rows without it."""
    return keys if below is None else keys.join(keys.where(F.col("id") <= below).select("key").distinct(), "key", "left_semi")


def pairs_of(keys: DataFrame, *also: str, star: bool = False, below: str | None = None) -> DataFrame:
    """Pairs id1 < id2 of the rows that share a key, with the columns ``also`` of both sides as <column>1 and <column>2;
    with ``below`` only those whose id1 is not greater.

    Keys of many rows are cut into pieces, so that pairs of pieces are dealt over all tasks; the number of tasks
    follows the number of pairs, as the rows themselves are too small for Spark to tell."""
    side = lambda n, df, *more: df.select("key", *more, F.col("id").alias(f"id{n}"), *(F.col(c).alias(f"{c}{n}") for c in also))
    if star:
        left = side(1, keys).join(keys.groupBy("key").agg(F.min("id").alias("id1")), ["key", "id1"])
        return left.join(side(2, keys), "key").where("id1 < id2")
    keys = reached(keys, below)
    sizes = keys.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    pairs, most = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.max("n")).first()
    tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((pairs or 0) / TASK_PAIRS))
    if (most or 0) <= PIECE:
        cut = keys.withColumns({"_n": F.lit(1), "_piece": F.lit(0)})
    else:
        large = sizes.where(F.col("n") > PIECE).select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("_n"))
        cut = keys.join(large, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_piece", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = side(1, (cut if below is None else cut.where(F.col("id") <= below)).withColumn("_other", every), "_piece", "_other")
    right = side(2, cut.withColumnRenamed("_piece", "_other").withColumn("_piece", every), "_piece", "_other")
    on = ["key", "_piece", "_other"]
    return left.repartition(tasks, *on).hint("merge").join(right.repartition(tasks, *on), on).where("id1 < id2").drop("_piece", "_other")


#: Names of a key in one piece, and records of a name in one chunk; more are cut.
PIECE_NAMES, CHUNK = 500, 2000


def named_pairs_of(keys: DataFrame, least: float, *also: str, below: str | None = None) -> DataFrame:
    """Pairs id1 < id2 of the rows (key, id, name) that share a key and whose names reach the similarity, with key,
    name_sim, also as percent, and the columns ``also`` of both sides (name among them); with ``below`` only those whose id1 is not greater.

    Records of one key and name are one class. Each two names that meet are compared once, whatever the keys; classes
    then meet in their key, each with a map of the similarities of its name, and only classes that are similar are
    taken apart to records. So no pair of records is shuffled."""
    from .bounded import similar_meeting

    keys = storage.saved(reached(keys.where("key is not null and name <> ''"), below).distinct(), "keys")
    sizes = keys.groupBy("key", "name").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("names"), F.max("n").alias("most")).where("n > 1")
    sizes = storage.saved(sizes.select("key", F.ceil(F.col("names") / PIECE_NAMES).cast("int").alias("_p"), F.ceil(F.col("most") / CHUNK).cast("int").alias("_c"), "n"), "sizes")
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0]
    tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / TASK_PAIRS))
    some = keys.join(sizes.drop("n"), "key")
    part = lambda name: F.pmod(F.xxhash64(name), F.col("_p")).cast("int")
    columns = [c for c in dict.fromkeys(also) if c != "name"]
    classes = some.groupBy("key", "name", "_p", "_c", F.pmod(F.xxhash64("id"), F.col("_c")).cast("int").alias("_chunk")).agg(F.collect_list(F.struct("id", *columns)).alias("members"))
    classes = storage.saved(classes.withColumn("_own", part("name") * F.col("_c") + F.col("_chunk")), "classes")
    sims = similar_meeting(some.select("key", "name").distinct(), least).groupBy(F.col("name1").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("name2", "name_sim"))).alias("sims"))
    within = F.when(F.col("_p") == 1, F.col("sims")).otherwise(F.map_filter("sims", lambda name, _: part(name) == F.col("_part")))
    first = classes if below is None else classes.withColumn("members", F.filter("members", lambda x: x["id"] <= below)).where(F.size("members") > 0)
    left = first.join(sims, "name").select("key", "name", "members", "sims", "_p", "_c", F.col("_own").alias("_piece"), F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_part")).withColumn("sims", within).where(F.size("sims") > 0)
    left = left.select("key", F.col("name").alias("name1"), F.col("members").alias("members1"), "sims", "_piece", F.explode(F.sequence(F.col("_part") * F.col("_c"), (F.col("_part") + 1) * F.col("_c") - 1)).alias("_other"))
    right = classes.select("key", F.col("name").alias("name2"), F.col("members").alias("members2"), F.col("_own").alias("_other"), F.explode(F.sequence(F.lit(0), F.col("_p") * F.col("_c") - 1)).alias("_piece"))
    on = ["key", "_piece", "_other"]
    met = left.repartition(tasks, *on).hint("merge").join(right.repartition(tasks, *on), on).withColumn("name_sim", F.try_element_at("sims", F.col("name2"))).where("name_sim is not null")
    shown = ["key", "name_sim", "percent", "name1", "name2"]
    one = met.withColumn("percent", percent(F.col("name_sim"))).select(*shown, "members2", F.explode("members1").alias("a"))
    both = one.select(*shown, "a", F.explode("members2").alias("b")).where("a.id < b.id")
    return both.select(*shown, F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), *(F.col(f"{x}.{c}").alias(f"{c}{n}") for c in columns for x, n in (("a", 1), ("b", 2))))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row: conditions on what a generator gives are not moved
    below it, so that they do not repeat the expressions."""
    both = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.explode(F.array(both)).alias("_computed")).select(*(f"`{c}`" for c in df.columns), *(F.col(f"_computed.{name}").alias(name) for name in columns))


def percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def rule(pairs: DataFrame, rank: int, kind: str, confidence: float, fields: list[str], explanation: Column, *also: str) -> DataFrame:
    return pairs.select("id1", "id2", F.lit(kind).alias("match_type"), F.lit(confidence).alias("confidence_score"), F.array(*map(F.lit, fields)).alias("matching_fields"), explanation.alias("explanation"), F.lit(rank).alias("rule_rank"), "key", *also)


def first_rule(*rules: DataFrame) -> DataFrame:
    """One match for each pair: of the earliest rule, and of its smallest key."""
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    best = every.groupBy("id1", "id2").agg(F.min_by(F.struct(*MATCH[2:], "rule_rank"), F.struct("rule_rank", "key")).alias("m"))
    return best.select("id1", "id2", "m.*")


def det_company_domain(rows: DataFrame, star: bool = False) -> DataFrame:
    keys = rows.select(F.explode("all_domains").alias("key"), F.col("record_id").alias("id"))
    return domain_rule(pairs_of(keys, star=star))


def domain_rule(pairs: DataFrame, *also: str) -> DataFrame:
    return rule(pairs, 1, "deterministic_high", 0.97, ["domain"], F.concat(F.lit("Shared domain: "), "key"), *also)


def dealt(pairs: DataFrame) -> DataFrame:
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id1", "id2")


def with_name_sim(pairs: DataFrame) -> DataFrame:
    """Pairs, dealt evenly over all tasks as the similarity takes far longer than they take to move, with name_sim."""
    return computed(dealt(pairs), name_sim=s.jaro_winkler(F.col("name1"), F.col("name2")))


def with_value_sim(pairs: DataFrame, keys: DataFrame, column: str, to: str) -> DataFrame:
    """Pairs of ``pairs_of(keys, column)`` with the similarity of a column as ``to``, which is computed once for each two values that meet."""
    values = keys.select("key", column).where(F.col(column) != "").distinct()
    side = lambda n: values.select("key", F.col(column).alias(f"{column}{n}"))
    on = [f"{column}1", f"{column}2"]
    meeting = side(1).join(side(2), "key").select(*on).distinct()
    meeting = meeting.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    sims = storage.saved(computed(meeting, **{to: s.jaro_winkler(F.col(on[0]), F.col(on[1]))}), "sims")
    return pairs.join(sims, on, "left").withColumn(to, F.coalesce(to, F.lit(0.0)))


def gate_generic_root(keys: DataFrame) -> DataFrame:
    """Keys but root domains that many organizations share and those of fewer than 5 characters."""
    return keys.where(generic_root_passes(F.col("key")))


def generic_root_passes(root: Column) -> Column:
    return ~root.isin(*GENERIC_ROOTS) & (F.length(root) >= 5)


def root_keys(rows: DataFrame) -> DataFrame:
    roots = rows.where("name is not null").select("record_id", "name", F.explode("all_domains").alias("d")).select("record_id", "name", t.root_domain(F.col("d")).alias("root"))
    return gate_generic_root(keyed(roots, F.col("root"), "name"))


def det_company_root(rows: DataFrame) -> DataFrame:
    return root_rule(named_pairs_of(root_keys(rows), 0.75))


def root_rule(pairs: DataFrame, *also: str) -> DataFrame:
    return rule(pairs, 2, "deterministic_high", 0.93, ["root_domain", "name"], F.concat(F.lit("Same root domain '"), "key", F.lit("' + similar name ("), "percent", F.lit(")")), *also)


def gate_linkedin(rows: DataFrame) -> DataFrame:
    """key and id of the pages whose slugs have 10 characters or more and that two to four records share."""
    slug = F.element_at(F.split("linkedin_url", "/"), -1)
    keys = keyed(rows.where(F.length(slug) >= 10), F.col("linkedin_url"))
    some = keys.groupBy("key").count().where("count between 2 and 4").select("key")
    return keys.join(some, "key", "left_semi")


def det_company_linkedin(rows: DataFrame) -> DataFrame:
    return linkedin_rule(pairs_of(gate_linkedin(rows)), 3, 0.95)


def linkedin_rule(pairs: DataFrame, rank: int, confidence: float, *also: str) -> DataFrame:
    return rule(pairs, rank, "deterministic_high", confidence, ["linkedin_url"], F.concat(F.lit("Exact LinkedIn URL match: "), "key"), *also)


def det_company_phone(rows: DataFrame) -> DataFrame:
    return phone_rule(named_pairs_of(keyed(rows, F.col("phone"), "name"), 0.75))


def phone_rule(pairs: DataFrame, *also: str) -> DataFrame:
    return rule(pairs, 4, "deterministic_medium", 0.88, ["phone", "name"], F.concat(F.lit("Same phone "), "key", F.lit(" + similar name ("), "percent", F.lit(")")), *also)


def det_contact_email(rows: DataFrame, star: bool = False) -> DataFrame:
    return email_rule(pairs_of(keyed(rows, F.col("email")), star=star))


def email_rule(pairs: DataFrame, *also: str) -> DataFrame:
    return rule(pairs, 1, "deterministic_high", 0.98, ["email"], F.concat(F.lit("Exact email match: "), "key"), *also)


def det_contact_linkedin(rows: DataFrame, star: bool = False) -> DataFrame:
    return linkedin_rule(pairs_of(keyed(rows, F.col("linkedin_url")), star=star), 2, 0.96)


def gate_email_conflict(pairs: DataFrame) -> DataFrame:
    """Pairs but those whose two e-mail addresses are of different domains."""
    return pairs.where(~email_conflict())


def email_conflict() -> Column:
    both = F.col("email1").isNotNull() & F.col("email2").isNotNull()
    return F.coalesce(F.when(both, t.email_domain(F.col("email1")) != t.email_domain(F.col("email2"))), F.lit(False))


def name_domain() -> Column:
    """The key of name and company domain; null where either is missing."""
    return F.when(F.col("block_key").isNotNull() & F.col("company_domain").isNotNull(), F.concat("block_key", F.lit(" @ "), "company_domain"))


def det_contact_name_domain(rows: DataFrame) -> DataFrame:
    return name_domain_rule(gate_email_conflict(named_pairs_of(keyed(rows, name_domain(), "name", "email"), 0.85, "email")))


def name_domain_rule(pairs: DataFrame, *also: str) -> DataFrame:
    return rule(pairs, 3, "deterministic_medium", 0.88, ["first_name", "last_name", "company_domain"], F.concat(F.lit("Same name + company domain: "), "key"), *also)


def pairs_by_first_rule(kind: str, rows: DataFrame, *also: str, ranks: tuple[int, ...] = (1, 2, 3, 4), below: str | None = None) -> DataFrame:
    """What ``first_rule`` gives of the rules of the kind that have these ranks, with the columns ``also`` of both sides;
    with ``below`` only pairs whose id1 is not greater.

    A pair comes from its first rule and that rule's smallest key alone: each pair is asked with what both of its
    records have whether an earlier rule or a smaller key has it too, so that pairs are not grouped in a shuffle."""
    given = tuple(f"{c}{n}" for c in also for n in (1, 2))
    once = lambda *names: tuple(dict.fromkeys((*names, *also)))
    before = lambda keys, many: keys.withColumn("before", F.filter(many, lambda x: x < F.col("key")))
    found, plain, named = {}, partial(pairs_of, below=below), partial(named_pairs_of, below=below)
    if kind == "company":
        roots = F.array_distinct(F.filter(F.transform("all_domains", t.root_domain), lambda r: F.coalesce(generic_root_passes(r), F.lit(False))))
        every = rows.select(*once("record_id", "name", "phone", "all_domains"), F.when(F.col("name").isNotNull(), roots).otherwise(F.array()).alias("roots"))
        every = every.join(gate_linkedin(rows).select(F.col("key").alias("linkedin"), F.col("id").alias("record_id")), "record_id", "left")
        keyed_by = lambda key, *more: every.select(key.alias("key"), F.col("record_id").alias("id"), *once(*more)).where("key is not null")
        domain = shared("all_domains1", "all_domains2") if 1 in ranks else F.lit(False)
        if 1 in ranks:
            pairs = plain(before(keyed_by(F.explode("all_domains"), "all_domains"), "all_domains"), "before", *also)
            found[1] = domain_rule(pairs.where(~shared("before1", "before2")), *given)
        if 2 in ranks:
            keys = before(keyed_by(F.explode("roots"), "name", "all_domains", "roots"), "roots")
            found[2] = root_rule(named(keys, 0.75, "all_domains", "before", *also).where(~shared("before1", "before2") & ~domain), *given)
        # a pair of rule 3 or 4 has no pair of rule 2 where roots are shared and names are similar
        if 3 in ranks:
            alike = F.when(shared("roots1", "roots2"), s.jaro_winkler(F.col("name1"), F.col("name2")) >= 0.75).otherwise(False) if 2 in ranks else F.lit(False)
            found[3] = linkedin_rule(plain(keyed_by(F.col("linkedin"), "name", "all_domains", "roots"), *once("name", "all_domains", "roots")).where(~domain).where(~alike), 3, 0.95, *given)
        if 4 in ranks:
            root = shared("roots1", "roots2") if 2 in ranks else F.lit(False)
            linkedin = same("linkedin1", "linkedin2") if 3 in ranks else F.lit(False)
            found[4] = phone_rule(named(keyed_by(F.col("phone"), "name", "all_domains", "roots", "linkedin"), 0.75, "all_domains", "roots", "linkedin", *also).where(~domain & ~root & ~linkedin), *given)
    else:
        email = same("email1", "email2") if 1 in ranks else F.lit(False)
        linkedin = same("linkedin_url1", "linkedin_url2") if 2 in ranks else F.lit(False)
        every = lambda key, *more: keyed(rows, key, *once(*more))
        if 1 in ranks:
            found[1] = email_rule(plain(every(F.col("email")), *also), *given)
        if 2 in ranks:
            found[2] = linkedin_rule(plain(every(F.col("linkedin_url"), "email"), *once("email")).where(~email), 2, 0.96, *given)
        if 3 in ranks:
            found[3] = name_domain_rule(gate_email_conflict(named(every(name_domain(), "name", "email", "linkedin_url"), 0.85, "email", "linkedin_url", *also)).where(~email & ~linkedin), *given)
    return reduce(DataFrame.unionByName, found.values()).drop("key")


def block_cap(rows: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` records of each name block, by id."""
    nth = F.row_number().over(Window.partitionBy("block_key").orderBy("record_id"))
    return rows.where("block_key is not null").withColumn("nth", nth).where(F.col("nth") <= cap)


def cand_blocked(rows: DataFrame, cap: int | None) -> DataFrame:
    """Pairs within name blocks of the first ``cap`` records each; of all records without a cap."""
    capped = rows.where("block_key is not null") if cap is None else block_cap(rows, cap)
    return pairs_of(capped.select(F.col("block_key").alias("key"), F.col("record_id").alias("id"))).select("id1", "id2")


def cand_all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of a table of few rows (below the blocking threshold)."""
    return pairs_of(rows.select(F.lit(1).alias("key"), F.col("record_id").alias("id"))).select("id1", "id2")


def candidates_by_name(rows: DataFrame, settings: Settings) -> DataFrame:
    """``candidates`` whose names reach ``min_name_similarity``, with name_sim: only names that can are compared."""
    from .bounded import cand_bounded

    if settings.use_blocking and rows.limit(settings.blocking_min_candidates).count() >= settings.blocking_min_candidates:
        blocked = rows.where("block_key is not null")
        blocked = blocked if settings.block_cap is None else block_cap(rows, settings.block_cap)
    else:
        blocked = rows.withColumn("block_key", F.lit(""))
    return cand_bounded(blocked.select("record_id", "block_key", "name"), settings.min_name_similarity)


def candidates(rows: DataFrame, settings: Settings) -> DataFrame:
    if settings.use_blocking and rows.limit(settings.blocking_min_candidates).count() >= settings.blocking_min_candidates:
        return cand_blocked(rows, settings.block_cap)
    return cand_all_pairs(rows)


def anti_exclude(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    return pairs.join(matched.select("id1", "id2"), ["id1", "id2"], "left_anti")


def shared(one: str, other: str) -> Column:
    return F.coalesce(F.arrays_overlap(one, other), F.lit(False))


def same(one: str, other: str) -> Column:
    return F.coalesce(F.col(one) == F.col(other), F.lit(False))


def unmatched(kind: str, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (id1 < id2) that no rule of the kind matches: what ``anti_exclude`` leaves with all that the rules give.

    Each pair is asked for itself, with the keys of both records, so that the work follows these pairs
    and not the square of the records that share a key."""
    if kind == "company":
        roots = F.transform("all_domains", t.root_domain)
        keys = rows.select("record_id", "name", "phone", "all_domains", F.filter(roots, lambda r: F.coalesce(generic_root_passes(r), F.lit(False))).alias("roots"))
        keys = keys.join(gate_linkedin(rows).select(F.col("key").alias("linkedin"), F.col("id").alias("record_id")), "record_id", "left")
        both = both_sides(pairs, keys, ["name", "phone", "all_domains", "roots", "linkedin"])
        certain, alike, least = shared("all_domains1", "all_domains2") | same("linkedin1", "linkedin2"), shared("roots1", "roots2") | same("phone1", "phone2"), 0.75
    else:
        keys = rows.select("record_id", "name", "email", "linkedin_url", name_domain().alias("key"))
        both = both_sides(pairs, keys, ["name", "email", "linkedin_url", "key"])
        certain, alike, least = same("email1", "email2") | same("linkedin_url1", "linkedin_url2"), same("key1", "key2") & ~email_conflict(), 0.85
    both = both if "name_sim" in pairs.columns else dealt(both)
    sim = F.col("name_sim") if "name_sim" in pairs.columns else s.jaro_winkler(F.col("name1"), F.col("name2"))
    return both.where(~certain).where(~F.when(alike, sim >= least).otherwise(False)).select(*pairs.columns)


def both_sides(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    side = lambda n: rows.select(F.col("record_id").alias(f"id{n}"), *(F.col(c).alias(f"{c}{n}") for c in columns))
    return pairs.join(side(1), "id1").join(side(2), "id2")


def classify(score: Column, settings: Settings) -> Column:
    return F.when(score >= settings.probabilistic_high_threshold, "probabilistic_high").when(score >= settings.probabilistic_medium_threshold, "probabilistic_medium")


def score_explanation(kind: Column, score: Column) -> Column:
    return F.concat(F.when(kind == "probabilistic_high", "High").otherwise("Medium"), F.lit(" similarity match (score: "), F.format_string("%.3f", score), F.lit(")"))


def field_list(**tests: Column) -> Column:
    """Names of the tests that hold."""
    return F.filter(F.array(*(F.when(c, name) for name, c in tests.items())), lambda x: x.isNotNull())


def gate_generic_prefix(pairs: DataFrame, least: float = 0.94) -> DataFrame:
    """Names that share a first word that says little must be the more similar."""
    generic = (t.first_word(F.col("name1")) == t.first_word(F.col("name2"))) & t.first_word(F.col("name1")).isin(*GENERIC_PREFIXES)
    return pairs.where(~F.coalesce(generic, F.lit(False)) | (F.col("name_sim") >= least))


def gate_location_mismatch(pairs: DataFrame, least: float = 0.95) -> DataFrame:
    """Names of records in different states must be the more similar."""
    elsewhere = F.lower("state1") != F.lower("state2")
    return pairs.where(~F.coalesce(elsewhere, F.lit(False)) | (F.col("name_sim") >= least))


def gate_company(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs with name_sim that pass the gates on names, generic first words and states."""
    return gate_location_mismatch(gate_generic_prefix(pairs.where(F.col("name_sim") >= settings.min_name_similarity)))


def score_company(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs with city_sim, industry_sim, score and dims."""
    w, c = settings.similarity_weights, F.col
    pairs = computed(pairs, city_sim=s.jaro_winkler(F.lower("city1"), F.lower("city2")), industry_sim=s.jaro_winkler(F.lower("industry1"), F.lower("industry2")))
    parts = pairs.withColumn("loc_sim", s.location_similarity(c("city_sim"), c("state1"), c("state2"), c("country1"), c("country2"))).withColumn("phone_sim", s.equal_score(c("phone1"), c("phone2"))).withColumn("emp_sim", s.employee_similarity(c("employee_count1"), c("employee_count2")))
    total = w["name"] * c("name_sim") + w["location"] * c("loc_sim") + w["industry"] * c("industry_sim") + w["phone"] * c("phone_sim") + w["employee_count"] * c("emp_sim")
    dims = sum((F.when(x, 1).otherwise(0) for x in (c("loc_sim") > 0.5, c("industry_sim") > 0.7, c("phone_sim") > 0.5, c("emp_sim") > 0.5)), F.lit(0))
    return parts.withColumn("score", F.least(total / sum(w.values()), F.lit(1.0))).withColumn("dims", dims)


def matching_fields_company() -> Column:
    c = F.col
    return field_list(
        domain=F.arrays_overlap("all_domains1", "all_domains2"), name=c("name_sim") > 0.75, linkedin_url=c("linkedin_url1") == c("linkedin_url2"), phone=c("phone1") == c("phone2"), city=c("city_sim") > 0.85,
        state=F.lower("state1") == F.lower("state2"), industry=c("industry_sim") > 0.85,
    )


COMPANY_SIDES = ["name", "all_domains", "linkedin_url", "phone", "city", "state", "country", "industry", "employee_count"]
CONTACT_SIDES = ["name", "first_name", "last_name", "email", "company_name", "company_domain", "job_title"]


def named_pairs(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with both records' columns and name_sim, which is computed where the pairs do not have it yet."""
    both = both_sides(pairs, rows, columns)
    return dealt(both) if "name_sim" in pairs.columns else with_name_sim(both)


def probabilistic_company(rows: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    named = named_pairs(pairs, rows, COMPANY_SIDES)
    scored = score_company(gate_company(named, settings), settings)
    scored = scored.where((F.col("dims") >= settings.min_matching_dimensions) | (F.col("name_sim") >= settings.sparse_min_name_similarity))
    scored = scored.withColumn("match_type", classify(F.col("score"), settings)).where("match_type is not null")
    return scored.select("id1", "id2", "match_type", F.col("score").alias("confidence_score"), matching_fields_company().alias("matching_fields"), score_explanation(F.col("match_type"), F.col("score")).alias("explanation"))


def cross_domain() -> Column:
    a, b = t.missing(t.email_domain(F.col("email1"))), t.missing(t.email_domain(F.col("email2")))
    return F.coalesce(a != b, F.lit(False))


def gate_contact(pairs: DataFrame, settings: Settings) -> DataFrame:
    return pairs.where(F.col("name_sim") >= settings.min_name_similarity).where(~F.col("cross") | (F.col("name_sim") >= settings.cross_domain_min_name_similarity))


def score_contact(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs with company_sim, title_sim, score and dims."""
    w, c = settings.similarity_weights, F.col
    parts = computed(pairs, company_sim=s.jaro_winkler(c("company_name1"), c("company_name2")), title_sim=s.jaro_winkler(c("job_title1"), c("job_title2"))).withColumn("domain_sim", s.equal_score(c("company_domain1"), c("company_domain2")))
    total = w["name"] * c("name_sim") + w["company"] * c("company_sim") + w["title"] * c("title_sim") + w["domain"] * c("domain_sim")
    dims = sum((F.when(x, 1).otherwise(0) for x in (c("company_sim") > 0.7, c("title_sim") > 0.7, c("domain_sim") > 0.5)), F.lit(0))
    return parts.withColumn("score", F.least(total / sum(w.values()), F.lit(1.0))).withColumn("dims", dims)


def matching_fields_contact() -> Column:
    c = F.col
    return field_list(
        email=c("email1") == c("email2"), first_name=s.jaro_winkler(c("first_name1"), c("first_name2")) > 0.8, last_name=s.jaro_winkler(c("last_name1"), c("last_name2")) > 0.8, company_name=c("company_sim") > 0.7,
        company_domain=c("company_domain1") == c("company_domain2"), job_title=c("title_sim") > 0.7,
    )


def probabilistic_contact(rows: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    named = named_pairs(pairs, rows, CONTACT_SIDES).withColumn("cross", cross_domain())
    scored = score_contact(gate_contact(named, settings), settings)
    scored = scored.where((F.col("dims") > 1) | (F.col("name_sim") >= settings.sparse_min_name_similarity))
    scored = scored.withColumn("match_type", F.when(F.col("cross"), "probabilistic_medium").otherwise(classify(F.col("score"), settings))).where("match_type is not null")
    confidence = F.when(F.col("cross"), F.round(F.col("name_sim") * 0.85, 4)).otherwise(F.col("score"))
    said = F.when(F.col("cross"), F.concat(F.lit("Same name across different organizations (name similarity "), percent(F.col("name_sim")), F.lit(")"))).otherwise(score_explanation(F.col("match_type"), F.col("score")))
    return scored.select("id1", "id2", "match_type", confidence.alias("confidence_score"), matching_fields_contact().alias("matching_fields"), said.alias("explanation"))


def recommend_survivor(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """matches with the id of the record to keep; the first wins ties."""
    side = lambda n: scores.select(F.col("record_id").alias(f"id{n}"), F.col("survivor_score").alias(f"s{n}"))
    both = matches.join(side(1), "id1").join(side(2), "id2")
    return both.withColumn("survivor", better("s1", "s2")).drop("s1", "s2")


def better(one: str, other: str) -> Column:
    """The id with the higher score; the first wins ties."""
    return F.when(F.col(one) >= F.col(other), F.col("id1")).otherwise(F.col("id2"))


def action(kind: Column) -> Column:
    from ..schema import ACTIONS

    table = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit("manual_review"))
