"""Similarities of names, places and sizes, as Column functions that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import missing


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity without case; 0 if either is missing, 1 if both are equal.

    Matches are greedy from the left; transpositions are halved as a fraction; the
    prefix bonus (0.1 for each of 4 characters at most) has no lower bound.
    """
    given = F.struct(F.split(F.lower(a), "").alias("x"), F.split(F.lower(b), "").alias("y"))

    def score(s: Column) -> Column:
        x, y = s["x"], s["y"]
        n, m = F.size(x), F.size(y)
        window = F.greatest(F.lit(0), F.floor(F.greatest(n, m) / 2).cast("int") - 1)

        def match(found: Column, i: Column) -> Column:
            low, high = F.greatest(F.lit(1), i - window), F.least(i + window, m)
            places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
            free = F.filter(places, lambda j: (F.element_at(y, j) == F.element_at(x, i)) & ~F.array_contains(found, j))
            return F.concat(found, F.array(F.coalesce(F.get(free, F.lit(0)), F.lit(0))))

        placed = F.filter(F.aggregate(F.sequence(F.lit(1), n), F.array().cast("array<int>"), match), lambda j: j > 0)
        # bound by a lambda, so that it is evaluated once
        return F.get(F.transform(F.array(placed), lambda p: finish(F.struct(p.alias("p"), F.sort_array(p).alias("q"), x.alias("x"), y.alias("y")))), F.lit(0))

    def finish(s: Column) -> Column:
        x, y, k = s["x"], s["y"], F.size(s["p"])
        swapped = F.size(F.filter(F.zip_with(s["p"], s["q"], lambda p, q: F.element_at(y, p) != F.element_at(y, q)), lambda d: d))
        jaro = (k / F.size(x) + k / F.size(y) + F.try_divide(k - swapped / 2, k)) / 3
        equal = [F.coalesce(F.get(x, F.lit(i)) == F.get(y, F.lit(i)), F.lit(False)) for i in range(4)]
        prefix = F.lit(4)
        for i in range(3, -1, -1):
            prefix = F.when(~equal[i], i).otherwise(prefix)
        return F.when(k == 0, 0.0).otherwise(jaro + F.lit(0.1) * prefix * (1 - jaro))

    both = missing(a).isNotNull() & missing(b).isNotNull()
    return F.when(~both, 0.0).when(a == b, 1.0).otherwise(F.get(F.transform(F.array(given), score), F.lit(0)))


def employee_similarity(a: Column, b: Column) -> Column:
    some = (F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0)
    return F.when(some, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def equal_score(a: Column, b: Column) -> Column:
    return F.when(missing(a) == missing(b), 1.0).otherwise(0.0)


def location_similarity(city_similarity: Column, state_a: Column, state_b: Column, country_a: Column, country_b: Column) -> Column:
    return 0.5 * city_similarity + 0.3 * equal_score(F.lower(state_a), F.lower(state_b)) + 0.2 * equal_score(F.lower(country_a), F.lower(country_b))
