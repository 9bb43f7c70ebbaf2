"""Readers of records: CSV and JSON files with flexible column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import missing, strip
from ..schema import COMPANY_COLUMNS, COMPANY_FIELDS, CONTACT_COLUMNS, CONTACT_FIELDS, CONTACT_JSON_COLUMNS, NA_TOKENS


def int_parse(x: Column) -> Column:
    """Whole part of a number in text; null where there is none."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 9e18), d.try_cast("bigint"))


def coalesce_mapping(sources: list[Column]) -> Column:
    """The last of the sources that is not null."""
    return F.coalesce(*reversed(sources)) if sources else F.lit(None)


def raw_data_map(columns: list[str]) -> Column:
    if not columns:
        return F.create_map().cast("map<string,string>")
    every = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(f"`{c}`").cast("string") for c in columns)))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def mapped(rows: DataFrame, columns: dict[str, str], fields: dict[str, str], position: Column) -> DataFrame:
    """Canonical fields, raw_data of the columns that are not mapped, and position (input order)."""
    sources: dict[str, list[Column]] = {f: [] for f in fields}
    for source, name in columns.items():
        if source in rows.columns and name in fields:
            c = F.col(f"`{source}`")
            sources[name].append(int_parse(c) if fields[name] == "long" else c.cast("string"))
    picked = [coalesce_mapping(cs).cast(fields[f]).alias(f) for f, cs in sources.items()]
    rest = [c for c in rows.columns if c not in columns]
    out = rows.select(*picked, raw_data_map(rest).alias("raw_data"), position.alias("position"))
    return out.withColumn("record_id", F.coalesce("record_id", F.col("position").cast("string"))).where("record_id <> ''")


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], fields: dict[str, str], multi_line: bool = True) -> DataFrame:
    """All columns as text; usual tokens for missing values are null. Rows without an id get
    their place, which follows the order of one file's rows and of files' splits. Files whose
    values hold no line feeds are split among tasks with ``multi_line=False``."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path)
    rows = rows.select(*(F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in rows.columns))
    return mapped(rows, columns, fields, F.monotonically_increasing_id())


def scan_csv_company(spark: SparkSession, path: str, column_mapping: dict[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, COMPANY_COLUMNS | (column_mapping or {}), COMPANY_FIELDS, multi_line)


def scan_csv_contact(spark: SparkSession, path: str, column_mapping: dict[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    return read_csv(spark, path, CONTACT_COLUMNS | (column_mapping or {}), CONTACT_FIELDS, multi_line)


def json_item_to_record(items: DataFrame, columns: dict[str, str], fields: dict[str, str], id_key: str, property_key: str) -> DataFrame:
    """items: item (JSON text of one record) and position. Properties lie under property_key or in the item itself."""
    whole = F.from_json("item", "map<string,string>")
    inner = F.from_json(F.get_json_object("item", f"$.{property_key}"), "map<string,string>")
    rows = items.select("position", whole.alias("whole"), F.coalesce(inner, whole).alias("props"))
    some = lambda c: F.when(strip(c) != "", c)  # noqa: E731  blank is missing
    sources: dict[str, list[Column]] = {f: [] for f in fields}
    sources["record_id"].append(F.try_element_at("whole", F.lit(id_key)))
    for source, name in columns.items():
        if name in fields:
            c = some(F.try_element_at("props", F.lit(source)))
            sources[name].append(int_parse(c) if fields[name] == "long" else c)
    raw = F.map_filter("props", lambda k, v: v.isNotNull() & ~k.isin(*columns))
    return rows.select(*(coalesce_mapping(cs).cast(fields[f]).alias(f) for f, cs in sources.items()), raw.alias("raw_data"), "position").where(missing(F.col("record_id")).isNotNull())


def json_items(texts: DataFrame, results_key: str = "results") -> DataFrame:
    """texts: value, a JSON document {results_key: [...]}, a list of items or one item."""
    listed = F.from_json("value", "array<string>")
    inner = F.from_json(F.get_json_object("value", f"$.{results_key}"), "array<string>")
    one = F.when(~F.trim("value").startswith("["), F.array("value"))
    items = F.coalesce(inner, F.when(F.trim("value").startswith("["), listed), one)
    # in the order of documents and of the places in them
    return texts.select(F.explode(items).alias("item")).select(F.monotonically_increasing_id().alias("position"), "item")


def read_json(spark: SparkSession, path: str, columns: dict[str, str], fields: dict[str, str], results_key: str, property_key: str, id_key: str, lines: bool) -> DataFrame:
    """JSON documents, one a file or, with ``lines``, one a line, so that large files are split among tasks."""
    return json_item_to_record(json_items(spark.read.text(path, wholetext=not lines), results_key), columns, fields, id_key, property_key)


def scan_json_contact(spark: SparkSession, path: str, results_key: str = "results", property_key: str = "properties", id_key: str = "id", column_mapping: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    return read_json(spark, path, CONTACT_JSON_COLUMNS | (column_mapping or {}), CONTACT_FIELDS, results_key, property_key, id_key, lines)


def scan_json_company(spark: SparkSession, path: str, results_key: str = "results", property_key: str = "properties", id_key: str = "id", column_mapping: dict[str, str] | None = None, lines: bool = False) -> DataFrame:
    return read_json(spark, path, COMPANY_COLUMNS | (column_mapping or {}), COMPANY_FIELDS, results_key, property_key, id_key, lines)
