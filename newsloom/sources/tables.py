"""Tables as they come: CSV with marks and blanks, JSON payloads, configuration files, archive trees, column synonyms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """All columns as trimmed text, null as empty; a byte order mark in the header is dropped; missing columns are an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("﻿").removeprefix("ï»¿").strip() for c in df.columns]
    df = df.toDF(*names)
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names])


def rows_of_csv(df: DataFrame, text_col: str, columns: Sequence[str]) -> DataFrame:
    """One row a line of CSV texts (without headers of their own), its named columns trimmed; blank lines give none, a cell holds no line break."""
    lines = df.select(*[c for c in df.columns if c != text_col], F.posexplode(F.split(F.regexp_replace(text_col, "^\ufeff", ""), r"\r?\n")).alias("line_no", "_line")).where(F.length(F.trim("_line")) > 0)
    parsed = F.from_csv("_line", ", ".join(f"`{c}` string" for c in columns), {"ignoreLeadingWhiteSpace": "true"})
    return lines.select(*[c for c in lines.columns if c != "_line"], *[F.trim(F.coalesce(parsed[c], F.lit(""))).alias(c) for c in columns])


def config_errors(df: DataFrame, required: Sequence[str] = ("station_id", "station_name")) -> DataFrame:
    """``line_no, error`` of configuration rows (numbered from 2, after the header) that lack something."""
    lacks = F.array_compact(F.array(*[F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0, F.lit(c)) for c in required]))
    return df.where(F.size(lacks) > 0).select("line_no", F.concat(F.lit("missing "), F.array_join(lacks, ", ")).alias("error"))


def keyed(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in the order; rows without a key are left out."""
    last = df.where(F.length(F.trim(F.col(key))) > 0).groupBy(F.trim(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("x"))
    return last.select("x.*")


def is_enabled(c: Column) -> Column:
    """Blank means enabled; 0, false, no and n mean not."""
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("0", "false", "no", "n")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, ("station_id", "station_name"))
    for c in ("page_url", "notes", "enabled"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.select("station_id", "station_name", "page_url", "notes", is_enabled(F.col("enabled")).alias("enabled"))


def payload_items(df: DataFrame, json_col: str, item_schema: str, names: Sequence[str] = ("results", "filings", "items", "data")) -> DataFrame:
    """Rows of a JSON payload: the list itself, or the first list under one of the names; others give no rows."""
    text = F.trim(F.col(json_col))
    inner = F.when(text.startswith("["), text).otherwise(F.coalesce(*[F.when(F.get_json_object(text, f"$.{n}").startswith("["), F.get_json_object(text, f"$.{n}")) for n in names]))
    items = F.filter(F.from_json(inner, f"array<{item_schema}>"), lambda x: x.isNotNull())
    return df.select(*[c for c in df.columns if c != json_col], F.explode(items).alias("item"))


def read_json_tolerant(df: DataFrame, text_col: str, schema: str) -> DataFrame:
    """``payload, error``: the parsed text, or null and why not."""
    parsed = F.from_json(text_col, schema)
    broken = F.col(text_col).isNull() | (F.length(F.trim(text_col)) == 0)
    return df.select("*", parsed.alias("payload"), F.when(broken, "missing").when(F.try_parse_json(text_col).isNull(), "corrupt").alias("error"))


def archive_tree(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """``path, station_id, archived, file_name, size, sha256`` of files under ``root/station/date/``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -3).alias("station_id"), F.element_at(parts, -2).alias("archived"), F.element_at(parts, -1).alias("file_name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def synonym(row: Column, names: Sequence[str]) -> Column:
    """The first of some column names, whatever its case, whose value isn't empty; ``row`` is a map."""
    low = F.map_from_entries(F.transform(F.map_entries(row), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"))))
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(low, F.lit(n.lower()))), F.lit("")) for n in names])


def row_text(row: Column) -> Column:
    return F.lower(F.array_join(F.map_values(row), " "))


def first_name(values: Column) -> Column:
    """Names out of a list of texts or of JSON objects with name, label or value."""
    pull = lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.label"), F.get_json_object(x, "$.value"), x)
    return F.transform(values, pull)
