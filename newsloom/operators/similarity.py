"""Near-duplicate headlines: pairs of distinct word sets, stories already told, greedy stories.

Word sets are compared once each: rows with the same set are one representative, so copies cost
nothing. Candidates share one of a set's rare words (prefix filter), which loses no pair of
the asked similarity.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import has_any_term, tokens
from newsloom.session import staged


def word_set(title: Column | str, stopwords: Sequence[str]) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens(title), lambda w: ~w.isin(*stopwords))))


def milestones(title: Column | str, groups: Sequence[Sequence[str]]) -> Column:
    """Which groups of milestone words a title uses: stories of different milestones differ."""
    return F.array_compact(F.array(*[F.when(has_any_term(title, g), F.lit(i)) for i, g in enumerate(groups)]))


def amounts(title: Column | str) -> Column:
    """The amounts a title names: stories that both name some, and not the same, differ."""
    low = F.lower(title if isinstance(title, Column) else F.col(title))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b\d+(?:\.\d+)?\s*(?:million|billion|percent|%)"), F.lit(0))))


def story_pairs(df: DataFrame, set_col: str, extra: Sequence[str] = (), jaccard: float = 0.8, shared: int = 4, many: int | None = None, contained: float = 0.85, apart: Sequence[str] = ()) -> DataFrame:
    """``ia, ib, set_a, set_b, similarity`` of the distinct word sets of at least the given Jaccard similarity.

    With ``many``, also of those that share so many words and that part of the smaller set. ``extra``
    must agree; lists in ``apart`` must agree unless one is empty. If the smaller of two sets of
    ``m <= n`` words shares ``t(m)`` with the larger, and that never less than ``t``, they have a common
    word among the ``m - t(m) + 1`` rarest of one and the ``n - t + 1`` rarest of the other.
    """
    keys = [set_col, *extra, *apart]
    sets = df.where(F.size(set_col) >= shared).select(*keys).distinct().withColumn("set_id", story_id(keys))
    words = sets.select("set_id", F.explode(set_col).alias("w"))
    rarity = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ranked = words.join(rarity, "w").groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("ws"))
    n = F.size("ws")
    by_share = F.greatest(F.lit(shared), F.ceil(n * (jaccard - 1e-9)).cast("int"))
    small = large = by_share
    if many is not None:
        small = F.least(by_share, F.greatest(F.lit(many), F.ceil(n * (contained - 1e-9)).cast("int")))
        large = F.least(by_share, F.lit(many))

    def side(at_least: Column, name: str) -> DataFrame:
        prefix = ranked.select("set_id", F.posexplode(F.slice("ws", F.lit(1), F.greatest(n - at_least + 1, F.lit(0)))).alias(f"at_{name}", "w"))
        return prefix.join(sets, "set_id").select("w", f"at_{name}", F.col("set_id").alias(f"i{name}"), F.col(set_col).alias(f"set_{name}"), *[F.col(e).alias(f"{e}_{name}") for e in (*extra, *apart)])

    left, right = side(small, "a"), side(large, "b")
    m, n = F.size("set_a"), F.size("set_b")
    needed = F.greatest(F.lit(shared), F.ceil((m + n) * (jaccard / (1 + jaccard)) - 1e-9))
    if many is not None:
        needed = F.least(needed, F.greatest(F.lit(many), F.ceil(m * contained - 1e-9)))
    # At the first word two sets have in common, what follows it bounds what they can share.
    on = (left["w"] == right["w"]) & ((m < n) | ((m == n) & (F.col("ia") < F.col("ib")))) & (F.least(m - F.col("at_a"), n - F.col("at_b")) >= needed)
    for e in extra:
        on = on & F.col(f"{e}_a").eqNullSafe(F.col(f"{e}_b"))
    for e in apart:
        on = on & ((F.size(f"{e}_a") <= 0) | (F.size(f"{e}_b") <= 0) | F.col(f"{e}_a").eqNullSafe(F.col(f"{e}_b")))
    both = F.size(F.array_intersect("set_a", "set_b"))
    met = left.join(right, on & (both >= needed))
    return met.select("ia", "ib", "set_a", "set_b", *[f"{e}_{x}" for x in "ab" for e in (*extra, *apart)], (both / (m + n - both)).alias("similarity")).dropDuplicates(["ia", "ib"])


def story_id(keys: Sequence[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*keys)))


def unlike_recent(items: DataFrame, recent: DataFrame, set_col: str, jaccard: float = 0.8, shared: int = 4, many: int | None = None, contained: float = 0.85, extra: Sequence[str] = (), apart: Sequence[str] = (), least: int = 0) -> DataFrame:
    """The items whose word set neither equals nor resembles one told recently.

    Equal sets of fewer than ``least`` words say nothing.
    """
    keys = [set_col, *extra, *apart]
    told = recent.select(*keys).distinct()
    pairs = story_pairs(items.select(*keys).unionByName(told), set_col, extra, jaccard, shared, many, contained, apart)
    ways = pairs.select(F.col("ia").alias("_new"), F.col("ib").alias("_old")).unionByName(pairs.select(F.col("ib").alias("_new"), F.col("ia").alias("_old")))
    known = told.select(story_id(keys).alias("_old"), F.size(set_col).alias("_words"))
    alike = ways.join(known, "_old", "left_semi").select("_new").unionByName(known.where(F.col("_words") >= least).select(F.col("_old").alias("_new"))).distinct()
    return items.withColumn("_id", story_id(keys)).join(alike, F.col("_id") == F.col("_new"), "left_anti").drop("_id")


def greedy_stories(spark: SparkSession, items: DataFrame, pos: str, order: Sequence[Column], set_col: str, jaccard: float = 0.55, shared: int = 4, many: int | None = 5, contained: float = 0.85, extra: Sequence[str] = (), apart: Sequence[str] = ()) -> DataFrame:
    """``pos, story``: each item, in ``order`` (ascending), joins the first story whose first item it resembles.

    From the pairs of distinct word sets: in each round the sets without an undecided earlier
    neighbour begin stories, and their neighbours are members. Sets too short to resemble any are
    stories of their own.
    """
    keys = [set_col, *extra, *apart]
    ranked = staged(spark, items.select(F.col(pos).alias("pos"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(pos).alias("pos")).alias("o"), *keys, story_id(keys).alias("node")), "stories")
    nodes = ranked.where(F.size(set_col) >= shared).groupBy("node").agg(F.min("o").alias("o"))
    pairs = story_pairs(ranked, set_col, extra, jaccard, shared, many, contained, apart).select("ia", "ib")
    pairs = pairs.join(nodes.select(F.col("node").alias("ia"), F.col("o").alias("oa")), "ia").join(nodes.select(F.col("node").alias("ib"), F.col("o").alias("ob")), "ib")
    a, b = F.struct(F.col("ia").alias("node"), F.col("oa").alias("o")), F.struct(F.col("ib").alias("node"), F.col("ob").alias("o"))
    first = F.col("oa") < F.col("ob")
    edges = staged(spark, pairs.select(F.when(first, a).otherwise(b).alias("e"), F.when(first, b).otherwise(a).alias("l")).select(F.col("e.node").alias("early"), F.col("e.o").alias("head"), F.col("l.node").alias("late")), "story-pairs")
    members, open_ = [], edges
    while not open_.isEmpty():
        begun = open_.join(open_.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        begun = staged(spark, begun.select("early", "late"), "story-round")
        joined = begun.select(F.col("late").alias("node")).distinct()
        members.append(joined)
        # Decided sets leave: those that began a story and those that joined one.
        gone = joined.unionByName(begun.select(F.col("early").alias("node"))).distinct()
        for side in ("early", "late"):
            open_ = open_.join(gone.withColumnRenamed("node", side), side, "left_anti")
        open_ = staged(spark, open_, "story-open")
    joined = reduce(DataFrame.unionByName, members) if members else edges.select(F.col("late").alias("node")).limit(0)
    heads = edges.join(joined.withColumnRenamed("node", "early"), "early", "left_anti").join(joined.withColumnRenamed("node", "late"), "late", "left_semi")
    told = heads.groupBy(F.col("late").alias("node")).agg(F.min("head").alias("head")).select("node", F.col("head.pos").alias("other"))
    own = nodes.select("node", F.col("o.pos").alias("own"))
    out = ranked.select("pos", "node").join(own, "node", "left").join(told, "node", "left")
    return out.select("pos", F.coalesce("other", "own", "pos").alias("story"))


def shown_of_story(stories: DataFrame, story: str, pos: str, order: Sequence[Column], weak: Column) -> DataFrame:
    """``story, shown``: the item a story is told by - its first, or the first that isn't weak where its first is."""
    rank = F.struct(weak.cast("int").alias("w"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(pos).alias("p"))
    return stories.groupBy(story).agg(F.min_by(pos, rank).alias("shown"))


def prefix_length(n: int, jaccard: float) -> int:
    """Words of a set of ``n`` that must be looked at to lose no pair of a similarity."""
    return n - math.ceil(n * jaccard - 1e-9) + 1
