"""Keep-first and keep-last, scoped dedupe, merged groups, whole-row distinct, upserts.

Order is always explicit and ends in a unique column. Where a group may be hot the operators
aggregate (which combines in the map tasks) instead of sorting the group in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import col


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One whole row a key, the first in the order; an aggregation, so hot keys are combined map-side."""
    rank = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def whole_row_distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def row_signature(df: DataFrame) -> Column:
    """One text for a row's columns and values, in the order of the names."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def merge_groups(df: DataFrame, key: str, order: str, score: str, published: str, source: str, carried: Sequence[str]) -> DataFrame:
    """One row a key: ``carried`` of its first row, ``best_*`` of its best scored one, latest date, sources in order, copies."""
    first, best = F.col(order), F.struct(F.col(score), -F.col(order))
    seen = F.array_sort(F.collect_set(F.struct(F.col(source).alias("s"))))
    return df.groupBy(key).agg(
        *[F.min_by(c, first).alias(c) for c in carried],
        F.max(score).alias("best_score"),
        F.max_by(order, best).alias("best_position"),
        F.max(published).alias("latest"),
        F.transform(seen, lambda x: x["s"]).alias("sources"),
        (F.count(F.lit(1)) - 1).alias("duplicate_count"),
    )


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Target rows with the changes' last row of each key in their place, and the new ones."""
    last = keep_first(changes, [key], [order], last=True).select(*target.columns)
    return target.join(last.select(key), key, "left_anti").unionByName(last)


def upsert_counts(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``inserted, updated, deduped`` of an upsert."""
    per = changes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(target.select(F.col(key), F.lit(1).alias("old")).distinct(), key, "left")
    return per.agg(F.count_if(F.col("old").isNull()).alias("inserted"), F.count_if(F.col("old").isNotNull()).alias("updated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deduped"))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``fresh`` give way to the fresh ones."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh.select(*children.columns))
