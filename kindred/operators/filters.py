"""Search requests: groups of filters joined by OR, filters in a group by AND."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import OBJECT_COLUMNS

COMPARE = {"EQ": "__eq__", "NEQ": "__ne__", "LT": "__lt__", "LTE": "__le__", "GT": "__gt__", "GTE": "__ge__"}
MOST_ROWS = 100


def search_objects(rows: DataFrame, kind: str, limit: int = 10, properties: list[str] | None = None, groups: list[list[dict]] | None = None, sorts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``search`` over objects of a registered kind; without properties, those that its kind shows by default."""
    if kind not in OBJECT_COLUMNS:
        raise ValueError(f"unknown kind of object {kind}: one of {', '.join(OBJECT_COLUMNS)}")
    return search(rows, limit, properties or OBJECT_COLUMNS[kind], groups, sorts)


def condition(name: str, operator: str, value: object = None) -> Column:
    """One filter; comparisons with a missing value do not hold."""
    column = F.col(name)
    if operator in COMPARE:
        return F.coalesce(getattr(column, COMPARE[operator])(F.lit(value)), F.lit(False))
    if operator == "CONTAINS_TOKEN":  # '*' stands for any characters; whole values, without case
        pattern = "(?is)" + ".*".join(re.escape(p) for p in str(value).split("*"))
        return F.coalesce(column.cast("string").rlike(f"^{pattern}$" if "*" in str(value) else rf"(?i)(?:^|[^\p{{L}}\p{{N}}]){re.escape(str(value))}(?:$|[^\p{{L}}\p{{N}}])"), F.lit(False))
    if operator in ("HAS_PROPERTY", "NOT_HAS_PROPERTY"):
        return column.isNotNull() if operator == "HAS_PROPERTY" else column.isNull()
    raise ValueError(f"unknown operator {operator}")


def filter_groups(rows: DataFrame, groups: list[list[dict]]) -> DataFrame:
    groups = [g for g in groups if g]
    if not groups:
        return rows
    return rows.where(reduce(or_, (reduce(and_, (condition(f["propertyName"], f["operator"], f.get("value")) for f in g)) for g in groups)))


def search(rows: DataFrame, limit: int = 10, properties: list[str] | None = None, groups: list[list[dict]] | None = None, sorts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Filter, sort (name, ASCENDING or DESCENDING), keep at most 100 rows, project."""
    found = filter_groups(rows, groups or [])
    if sorts:
        found = found.orderBy(*(F.desc(n) if way == "DESCENDING" else F.asc(n) for n, way in sorts))
    found = found.limit(min(limit, MOST_ROWS))
    return found.select(*properties) if properties else found
