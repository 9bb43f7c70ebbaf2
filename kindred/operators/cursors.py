"""Pages of a search by the place after which they go on, not by an offset.

A token holds the sorted values and the id of the last row that was read. The next page is the rows
that come after it: a condition on these columns, which reaches the scan, and the first
rows by order, so that neither earlier rows are sorted again nor rows that were added meanwhile
shift what is still to come. Nulls come first in ascending and last in descending order, as Spark sorts
them. Ids must be unique and not null; rows of an id that was read are not read again unless their values
move behind the token.
"""

from __future__ import annotations

import base64
import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, functions as F

from .. import storage
from .filters import MOST_ROWS, filter_groups


def place_after(order: list[tuple[str, str]], values: list[Column | None]) -> Column:
    """Rows that come later than these values (None: null) by (name, ASCENDING or DESCENDING), in a form that scans take."""
    found, same = [], []
    for (name, way), value in zip(order, values, strict=True):
        column = F.col(name)
        if way == "ASCENDING":
            later = column.isNotNull() if value is None else column > value
        else:
            later = None if value is None else column.isNull() | (column < value)
        if later is not None:
            found.append(reduce(and_, same, later))
        same.append(column.isNull() if value is None else column == value)
    return reduce(or_, found, F.lit(False))


def token_of(row: Row, names: list[str]) -> str:
    """Texts of the values, so that a token is the same on every machine."""
    return base64.urlsafe_b64encode(json.dumps([None if row[n] is None else str(row[n]) for n in names]).encode()).decode()


def values_of(token: str, names: list[str]) -> list[str | None]:
    try:
        values = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as e:
        raise ValueError(f"not a token: {token}") from e
    if not isinstance(values, list) or len(values) != len(names) or not all(v is None or isinstance(v, str) for v in values):
        raise ValueError("a token of another search")
    return values


def ordered(sorts: list[tuple[str, str]] | None, key: str) -> list[tuple[str, str]]:
    sorts = list(sorts or [])
    return sorts if any(n == key for n, _ in sorts) else [*sorts, (key, "ASCENDING")]


def by(order: list[tuple[str, str]]) -> list[Column]:
    return [F.desc(n) if way == "DESCENDING" else F.asc(n) for n, way in order]


def page(rows: DataFrame, key: str, limit: int = 10, after: str | None = None, properties: list[str] | None = None, groups: list[list[dict]] | None = None, sorts: list[tuple[str, str]] | None = None) -> tuple[list[Row], str | None]:
    """At most 100 rows behind a token, and the token of the next page; None if there are no more rows."""
    order, limit = ordered(sorts, key), min(limit, MOST_ROWS)
    names = [n for n, _ in order]
    if limit < 1:
        raise ValueError("a page has one row or more")
    found = filter_groups(rows, groups or [])
    if after is not None:
        found = found.where(place_after(order, [None if v is None else F.lit(v).cast(rows.schema[n].dataType) for n, v in zip(names, values_of(after, names), strict=True)]))
    shown = list(dict.fromkeys([*(properties or rows.columns), *names]))
    got = found.select(*shown).orderBy(*by(order)).limit(limit + 1).collect()  # one more tells whether there is a next page
    rest = token_of(got[limit - 1], names) if len(got) > limit else None
    out = [Row(**{n: r[n] for n in properties or rows.columns}) for r in got[:limit]]
    return out, rest


def all_pages(rows: DataFrame, key: str, limit: int = MOST_ROWS, properties: list[str] | None = None, groups: list[list[dict]] | None = None, sorts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every page at once: page (from 1), nth (in the page, from 1), the properties, and after, the id of the last row of the page before.

    One sort by range, and counts of the partitions before: no task sees all rows. Descending texts are
    sorted by their bytes turned round, so that places are counted in one direction."""
    order, limit = ordered(sorts, key), min(limit, MOST_ROWS)
    found = filter_groups(rows, groups or [])
    shown = list(dict.fromkeys(properties or rows.columns))
    keyed = found.select(*shown, F.col(key).alias("_key"), *(turned(found, n, way).alias(f"_o{i}") for i, (n, way) in enumerate(order)))
    places = storage.numbered(keyed, *(f"_o{i}" for i in range(len(order))))
    paged = places.withColumn("page", F.floor((F.col("nth") - 1) / limit) + 1).withColumn("nth", (F.col("nth") - 1) % limit + 1)
    last = paged.where(F.col("nth") == limit).select((F.col("page") + 1).alias("page"), F.col("_key").alias("after"))
    return paged.join(last, "page", "left").select("page", "nth", *shown, "after")


def turned(rows: DataFrame, name: str, way: str) -> Column:
    """A column that sorts upwards as the given one sorts in its way."""
    column, kind = F.col(name), dict(rows.dtypes)[name]
    if way == "ASCENDING":
        return column
    if kind == "string":
        digits, back = "0123456789ABCDEF", "FEDCBA9876543210"
        value = F.concat(F.translate(F.hex(column.cast("binary")), digits, back), F.lit("G"))
    elif kind == "boolean":
        value = ~column
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        value = -(F.unix_date(column) if kind == "date" else F.unix_micros(column.cast("timestamp")))
    else:
        value = -column
        if kind in ("float", "double"):  # NaN is greatest
            return F.struct(column.isNull().alias("none"), (~F.isnan(column)).alias("number"), value.alias("value"))
    return F.struct(column.isNull().alias("none"), value.alias("value"))
