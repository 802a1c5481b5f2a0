"""Top-k, best of group, ties, capped and interleaved rankings, running layout counts, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def top_k(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """A page of the ordered rows; Spark keeps only ``offset + k`` rows a task."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most ``k`` rows a group; the row-number filter is pushed below the shuffle (a group limit), so hot groups shrink first."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def best_with_ties(df: DataFrame, group: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """All rows that share a group's least composite rank, by an aggregation and a join."""
    keyed = df.withColumn("_rank", F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    best = keyed.groupBy(*group).agg(F.min("_rank").alias("_best"))
    on = [keyed[g].eqNullSafe(best[g]) for g in group] + [keyed["_rank"] == best["_best"]]
    return keyed.join(best, on, "left_semi").drop("_rank")


def capped_ranking(df: DataFrame, group: str, order: Sequence[Column], per_group: int, k: int) -> DataFrame:
    """The ``k`` best rows of which no group has more than ``per_group``."""
    kept = top_k_per_group(df, [group], order, per_group).drop("rank")
    return top_k(kept, order, k)


def firsts_ahead(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The best row of each group before all others, each part in its order."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    ranked = top_k_per_group(df, [group], order, k).drop("rank").withColumn("is_first", (place == 1).cast("int"))
    return top_k(ranked, [F.desc("is_first"), *order], k)


def alternating_index(df: DataFrame, group: str, order: Sequence[Column], flag: Column) -> DataFrame:
    """How many flagged rows of the group came before, by turns 0 and 1."""
    before = F.coalesce(F.sum(flag.cast("int")).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("side", F.when(flag, before % 2))


def document_order(kinds: Sequence[str], levels: Sequence[str] = ("high", "medium", "low")) -> list[Column]:
    """Documents by importance: the latest of a station first, then kind, newest year, confidence, station and title."""
    place = lambda c, names: F.coalesce(*[F.when(F.lower(c) == n, i) for i, n in enumerate(names)], F.lit(len(names)))
    latest = F.when(F.coalesce("latest", F.lit(False)), 0).otherwise(1)
    return [latest.asc(), place("kind", kinds).asc(), F.desc(F.coalesce("year", F.lit(0))), place("confidence", levels).asc(), F.asc(F.coalesce("station_name", F.lit(""))), F.asc(F.coalesce("title", F.lit("")))]
