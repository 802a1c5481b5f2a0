"""Report tables and sinks: failure and health summaries, key-sorted maps, contexts, message batches, JSON, CSV, Markdown."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counts_map(df: DataFrame, column: str) -> DataFrame:
    """One row: a map from each value to its count, in the order of the values."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(column), F.lit("")), "n")))).alias("counts"))


def failure_summary(df: DataFrame, key: str, kind: str, order: str, error: str, url: str) -> DataFrame:
    """``key, failures, types, last_error, last_url`` by descending count: two small aggregations, no sort of a group."""
    per = df.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(order, error)).alias("e"), F.max(F.when(F.length(url) > 0, F.struct(order, url))).alias("u"))
    return per.groupBy(key).agg(
        F.sum("n").alias("failures"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("types"),
        F.max("e")[error].alias("last_error"),
        F.max("u")[url].alias("last_url"),
    )


def context_lines(df: DataFrame, group: str, order: Sequence[str], line: Column, most: int) -> DataFrame:
    """``group, context``: the first ``most`` lines of each group under one another, numbered ``[S1]``, ``[S2]`` ...

    Rows are ranked before they are collected, so a hot group never lies in one place.
    """
    rows = df.select(group, *order, line.alias("_l"))
    near = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("_r", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_r") <= most)
    top = near.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most)
    lines = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", "_l"))).alias("xs"))
    return lines.select(group, F.array_join(F.transform("xs", lambda x: F.concat(F.lit("[S"), x["_r"].cast("string"), F.lit("] "), x["_l"])), "\n").alias("context"))


def message_lines(title: Column, link: Column, source: Column, most: int = 350) -> tuple[Column, Column]:
    """An item's line with its link, and the one without for lines that would fill a message alone; titles are cut, marks escaped."""
    flat = F.trim(F.regexp_replace(F.coalesce(title, F.lit("(no title)")), r"\s+", " "))
    short = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name, tail = escaped(F.replace(short, F.lit("|"), F.lit("·"))), F.concat(F.lit(" ("), F.coalesce(source, F.lit("")), F.lit(")"))
    return F.concat(F.lit("- <"), escaped(F.coalesce(link, F.lit(""))), F.lit("|"), name, F.lit(">"), tail), F.concat(F.lit("- "), name, tail)


def message_batches(df: DataFrame, group: str, order: Sequence[str], item: str, line: Column, spare: Column, limit: int = 3_900, head: str = "continued") -> DataFrame:
    """``group, batch, n_lines, text, items``: lines packed greedily, in order, into messages of at most ``limit`` characters.

    Messages after the first begin with ``head``. A line that would not fit a message of its own is replaced by
    ``spare``. A group is one report of one day; its rows are those of a digest. Null orders come first.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple[list[str], list]] = [([], [])]
        size, pdf = 0, pdf.sort_values("_n")
        for who, text, spare_ in zip(pdf["_item"], pdf["_line"], pdf["_spare"]):
            text = text if len(text) + len(head) + 1 <= limit else spare_
            if made[-1][0] and size + len(text) + 1 > limit:
                made.append(([], []))
                size = len(head) + 1
            made[-1][0].append(text)
            made[-1][1].append(who)
            size += len(text) + 1
        return pd.DataFrame(
            {"_group": pdf["_group"].iloc[0], "batch": range(len(made)), "n_lines": [len(t) for t, _ in made], "text": [(head + "\n") * (i > 0) + "\n".join(t) for i, (t, _) in enumerate(made)], "items": [w for _, w in made]}
        )

    kinds = dict(df.dtypes)
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    rows = df.select(F.col(group).alias("_group"), F.col(item).alias("_item"), line.alias("_line"), spare.alias("_spare"), place.alias("_n"))
    packed = rows.groupBy("_group").applyInPandas(pack, f"_group {kinds[group]}, batch long, n_lines long, text string, items array<{kinds[item]}>")
    return packed.withColumnRenamed("_group", group)


def sorted_keys(c: Column, kind: T.DataType) -> Column:
    """The same value with the fields of its structs and the keys of its maps in order."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sorted_keys(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def write_json(df: DataFrame, path: str) -> None:
    """One document a row, its keys sorted at every level."""
    df.select(F.to_json(F.struct(*[sorted_keys(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(df.columns)])).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row, ``markdown``: a small report table; its rows are those of a report."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    body = df.agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("_c")))).alias("xs"))
    return body.select(F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["_c"]), "\n")).alias("markdown"))


def reject_log(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those that don't with their reason."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
