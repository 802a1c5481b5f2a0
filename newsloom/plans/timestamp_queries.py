"""Queries of problem 6: one UTC instant for every written timestamp."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.timestamps import normalize_timestamps
from newsloom.session import table

#: table, id column, value column, expression of the key in source_zones
TIMESTAMP_COLUMNS = (
    ("feed_items", "item_id", "published", "feed_title"),
    ("ecfs_items", "filing_id", "date_received", "if(filing_id is null, '', '*')"),
    ("public_files_items", "item_id", "published_at", "source_call_sign"),
    ("articles", "id", "published_at", "try_parse_url(url, 'HOST')"),
)


def p6_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four columns with its instant, format, posterior and ambiguity mark."""
    key = lambda name, source: F.concat(name, F.lit("|"), source)
    parts = []
    for name, row_id, value, source in TIMESTAMP_COLUMNS:
        of = F.struct(F.lit(name).alias("t"), F.col(row_id).cast("long").alias("i"))
        parts.append(table(spark, sf_dir, name).select(of.alias("_id"), F.col(value).alias("_value"), key(F.lit(name), F.expr(source)).alias("_source")))
    # All columns go through at once: a source is a table's.
    zones = table(spark, sf_dir, "source_zones").select(key(F.col("source_table"), F.col("source_key")).alias("source"), "zone")
    out = normalize_timestamps(reduce(DataFrame.unionByName, parts), "_id", "_value", "_source", zones)
    return out.select(F.col("row_id.t").alias("source_table"), F.col("row_id.i").alias("row_id"), *[c for c in out.columns if c != "row_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_instants(spark, sf_dir).where("epoch_us is not null").select("source_table", F.col("row_id").cast("long").alias("row_id"), "epoch_us")


QUERIES = {"p6_found": p6_found, "p6_instants": p6_instants}
ORACLES: dict[str, str] = {}
