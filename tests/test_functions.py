"""Values of single functions."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kindred.functions import quality as q, similarity as s, text as t

CASES = {
    t.norm_domain: {"HTTPS://WWW.Foo.example/a": "foo.example", "foo": None, "www.foo.example/": "foo.example", "": None, None: None, " Foo.Example ": "foo.example"},
    t.url_netloc: {"foo.example:8080/x": "foo.example:8080", "http://u@www.foo.example": "u@www.foo.example", "http://www.foo.example?x": "foo.example", "foo": None, None: None},
    t.root_domain: {"a.b.example": "b.example", "x.y.co.uk": "y.co.uk", "co.uk": "co.uk", "x.org.uk": "org.uk", "x": None, None: None},
    t.norm_phone: {"+1 (617) 555-0100": "6175550100", "555-01": None, "44 20 7946 0000": "442079460000", None: None},
    t.norm_company_name: {"Foo  Widgets, Inc.": "Foo Widgets,", "Health Inc": "Health Inc", "The Co Op": "The Op", "Société Générale SA": "Société Générale", "": None},
    t.block_key_company: {"A1b": None, "Abc": "abc", "Foo Bar": "foob", None: None},
    t.norm_person_name: {"o'BRIEN-smith": "Obriensmith", "!!": None, "josé maría": "José María"},
    t.norm_place: {"st. john's": "St. John'S", " new york ": "New York"},
    t.norm_state: {"ma": "Massachusetts", " TX ": "Texas", "ontario": "Ontario", "": None},
    t.norm_linkedin_person: {"https://linkedin.com/in/Foo#x": "linkedin.com/in/foo#x", "linkedin.com/in/a/b?c": "linkedin.com/in/a", " Other ": "other"},
    t.norm_linkedin_company: {"https://www.linkedin.com/company/Foo-Bar/about": "linkedin.com/company/foo-bar", "linkedin.com/school/x#y": "linkedin.com/school/x", "Foo ": "foo"},
    t.email_domain: {"a@b.c": "b.c", "a": "", None: "", "a@b@c": "b"},
    t.csv_escape: {"a": "a", "a,b": '"a,b"', 'a"b': '"a""b"', "a\nb": '"a\nb"', None: ""},
}


@pytest.mark.parametrize("function", CASES, ids=lambda f: f.__name__)
def test_scalars(spark, function):
    rows = list(CASES[function].items())
    found = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string").select("i", function(F.col("a")).alias("r")).orderBy("i").collect()
    assert [(rows[r.i][0], r.r) for r in found] == rows


def test_derived_domains(spark):
    rows = [("a@gmail.com", None, "gmail.com", None), ("a@x.gmail.com", None, None, None), ("a@b.example", "www.c.example/x", "c.example", "c.example"), ("a@b.example", None, "b.example", "b.example")]
    df = spark.createDataFrame(rows, "email string, website string, loose string, strict string")
    for r in df.select("loose", "strict", t.company_domain_derive(F.col("website"), F.col("email")).alias("l"), t.company_domain_derive(F.col("website"), F.col("email"), True).alias("s")).collect():
        assert (r.l, r.s) == (r.loose, r.strict)


def plain_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    a, b = a.lower(), b.lower()
    window = max(0, max(len(a), len(b)) // 2 - 1)
    taken, order = set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - window), min(len(b), i + window + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            order.append((x, j))
    if not order:
        return 0.0
    swaps = sum(x != b[j] for (x, _), j in zip(order, sorted(taken), strict=True))
    k = len(order)
    jaro = (k / len(a) + k / len(b) + (k - swaps / 2) / k) / 3
    prefix = next((i for i in range(4) if i >= min(len(a), len(b)) or a[i] != b[i]), 4)
    return jaro + 0.1 * prefix * (1 - jaro)


def test_jaro_winkler(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choices("abcdAB é", k=r.randrange(0, 12)))
    pairs = [(word(), word()) for _ in range(1500)] + [("martha", "marhta"), ("a", "A"), (None, "a"), ("dixon", "dicksonx")]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", s.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()
    for x in found:
        assert x.s == pytest.approx(plain_jaro_winkler(x.a, x.b), abs=1e-12) and 0 <= x.s <= 1


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_plain_jaro_winkler_is_bounded(a, b):
    assert 0 <= plain_jaro_winkler(a, b) <= 1 and (not a or plain_jaro_winkler(a, a) == 1)


def test_recency_and_employees(spark):
    rows = [("2024-01-01T05:00:00Z", 1.0025), ("garbage", 0.1), (None, 0.0), ("2022-08-19T00:00:00Z", 0.1), ("2023-12-22T00:00:00Z", 0.975)]
    for r in spark.createDataFrame(rows, "d string, e double").select("e", q.recency(F.col("d"), "2024-01-01T00:00:00Z").alias("r")).collect():
        assert r.r == pytest.approx(r.e)
    sizes = spark.createDataFrame([(50, 100, 0.5), (0, 5, 0.0), (None, 5, 0.0), (7, 7, 1.0)], "a long, b long, e double")
    for r in sizes.select("e", s.employee_similarity(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.r == r.e
