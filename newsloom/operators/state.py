"""State between runs as tables: seen ids, overlap windows, streaks, catch-up days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.join(seen.select(key).distinct(), key, "left_anti")


def remember(seen: DataFrame, emitted: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """Seen ids with the newly emitted ones, each once, the newest ``most`` by sequence."""
    both = seen.select(key, seq).unionByName(emitted.select(key, seq)).groupBy(key).agg(F.max(seq).alias(seq))
    return both.orderBy(F.desc(seq), key).limit(most)


def overlap_window(items: DataFrame, ts: str, last_checked: Column, now: Column, overlap_hours: int) -> DataFrame:
    """Items since the earlier of the last check and ``now - overlap``; undated ones always pass."""
    since = F.least(last_checked, now - F.make_interval(hours=F.lit(overlap_hours)))
    return items.where(F.col(ts).isNull() | (F.col(ts) >= since))


def failure_streaks(runs: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """``key, streak``: failures since each key's last success, 0 after a success.

    One aggregation: runs after the last success are all failures, so they are counted by comparison.
    """
    at = F.struct(*order)
    last_ok = runs.where(~failed).groupBy(key).agg(F.max(at).alias("_ok"))
    marked = runs.withColumn("_at", at).join(last_ok, key, "left")
    return marked.groupBy(key).agg(F.count_if(F.col("_ok").isNull() | (F.col("_at") > F.col("_ok"))).alias("streak"))


def islands(df: DataFrame, key: str, order: Sequence[str], flag: Column) -> DataFrame:
    """``key, island, first, last, n``: runs of consecutive flagged rows of each key."""
    w = W.partitionBy(key).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(w)).where(flag)
    grouped = numbered.withColumn("_g", F.col("_rn") - F.row_number().over(w))
    return grouped.groupBy(key, "_g").agg(F.min("_rn").alias("first_run"), F.max("_rn").alias("last_run"), F.count(F.lit(1)).alias("n")).drop("_g")


def catch_up_days(last_done: Column, today: Column, most: int = 14) -> Column:
    """The days after the last done one up to today, newest first, the newest ``most`` only."""
    first = F.greatest(F.date_add(last_done, 1), F.date_sub(today, most - 1))
    return F.when(first <= today, F.reverse(F.sequence(first, today, F.expr("interval 1 day")))).otherwise(F.array().cast("array<date>"))


def skip_update(last_checked: Column, now: Column, minutes: int = 45) -> Column:
    """An update that comes too soon after the last check is left out; without a last check none is."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last_checked) < minutes * 60_000_000, F.lit(False))


def delivered_items(messages: DataFrame, key: Sequence[str], order: str, ids: str, failed: DataFrame) -> DataFrame:
    """``key, id`` of the items in a report's messages before its first failed one; the rest stay eligible.

    ``failed``: ``key, order`` of messages that weren't taken. A report without failures is delivered whole.
    """
    first = failed.groupBy(*key).agg(F.min(order).alias("_failed"))
    sent = messages.join(first, list(key), "left").where(F.col("_failed").isNull() | (F.col(order) < F.col("_failed")))
    return sent.select(*key, F.explode(ids).alias("id"))


def next_check(reports: DataFrame, failed: DataFrame, key: Sequence[str], last: Column, now: Column) -> DataFrame:
    """``key, last_checked``: a report moves its check time on only if all of it was delivered."""
    broken = failed.select(*key).distinct().withColumn("_broken", F.lit(True))
    return reports.join(broken, list(key), "left").select(*key, F.when(F.col("_broken"), last).otherwise(now).alias("last_checked"))


def title_memory(memory: DataFrame, delivered: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """``title, sent``: the titles told within the last hours, with those delivered now."""
    recent = memory.where(F.col("sent") >= now - F.make_interval(hours=F.lit(hours))).select("title", "sent")
    return recent.unionByName(delivered.select("title", now.alias("sent"))).groupBy("title").agg(F.max("sent").alias("sent"))
