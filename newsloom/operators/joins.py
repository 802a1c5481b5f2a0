"""Joins with tiers, cascades and dictionaries; retry and replacement sets.

No join is forced into a broadcast: small dimensions are broadcast by the size Spark measures.
Multi-word dictionaries, whose size the caller bounds, become literals of one alternation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import bounded, col

#: Most phrases that may become literals of an expression.
MAX_PHRASES = 2_000


def two_tier(left: DataFrame, metrics: DataFrame, keys: tuple[str, str], value: str, order: str, default: int = 0) -> DataFrame:
    """Each left row with the metric of its exact key, else of its looser key, else the default.

    Within a tier the last row of a key counts; an exact hit of 0 doesn't fall through.
    """
    exact, loose = keys
    tier = lambda k, name: metrics.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_{name}")).agg(F.max_by(value, order).alias(name))
    out = left.join(tier(exact, "exact_value"), F.col(exact) == F.col("_exact_value"), "left").join(tier(loose, "loose_value"), F.col(loose) == F.col("_loose_value"), "left")
    return out.withColumn(value, F.coalesce("exact_value", "loose_value", F.lit(default))).drop("_exact_value", "_loose_value", "exact_value", "loose_value")


def cascade_match(df: DataFrame, tiers: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """``matched_by``: the first tier (name, column, keys) in which the row's column is one of the keys; null if none."""
    out, flags = df, []
    for i, (name, column, keys) in enumerate(tiers):
        key = keys.select(F.col(keys.columns[0]).alias(f"_k{i}")).where(F.col(f"_k{i}").isNotNull()).distinct()
        out = out.join(key, F.col(column) == F.col(f"_k{i}"), "left")
        flags.append(F.when(F.col(f"_k{i}").isNotNull(), F.lit(name)))
    return out.withColumn("matched_by", F.coalesce(*flags)).drop(*[f"_k{i}" for i in range(len(tiers))])


def alias_cascade(df: DataFrame, id_col: str, keys: Column, aliases: DataFrame, alias_col: str, target_col: str) -> DataFrame:
    """``id, target`` of the first of a row's keys that the alias table knows."""
    probes = df.select(F.col(id_col), F.posexplode(keys).alias("_pos", "_key"))
    known = aliases.select(F.col(alias_col).alias("_key"), F.col(target_col).alias("_target")).dropDuplicates(["_key"])
    return probes.join(known, "_key").groupBy(id_col).agg(F.min_by("_target", "_pos").alias(target_col))


def word_grams(words: Column, lengths: Sequence[int]) -> Column:
    """The runs of words of some lengths, each joined by blanks; a run grows word by word over the whole list at once."""
    made, run = [F.array().cast("array<string>")], words
    for n in range(1, max(lengths, default=0) + 1):
        if n > 1:
            # Beyond the end there is no word, and a run with none is none.
            run = F.zip_with(run, F.slice(words, F.lit(n), F.greatest(F.size(words), F.lit(0))), lambda r, w: F.concat(r, F.lit(" "), w))
        if n in lengths:
            made.append(F.array_compact(run))
    return F.array_distinct(F.concat(*made))


def token_dictionary(df: DataFrame, id_col: str, tokens: Column, terms: DataFrame, term_col: str, lengths: Sequence[int] = (1,)) -> DataFrame:
    """``id, terms``: the dictionary's terms of some numbers of words in each text, by an equi-join on its distinct runs of words."""
    words = df.select(F.col(id_col), tokens.alias("_w")).select(F.col(id_col), F.explode(word_grams(F.col("_w"), lengths)).alias("_t"))
    return words.join(terms.select(F.col(term_col).alias("_t")).distinct(), "_t").groupBy(id_col).agg(F.array_sort(F.collect_set("_t")).alias("terms"))


def phrase_dictionary(df: DataFrame, text: Column | str, phrases: Sequence[str]) -> Column:
    """The phrases (a bounded list) that stand by themselves in a text; only texts with any are tested one by one."""
    if len(phrases) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases; use token_dictionary or a join")
    low = F.lower(col(text))
    each = F.filter(F.array(*[F.when(low.rlike(bounded(p)), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())
    any_ = low.rlike("|".join(bounded(p) for p in phrases))
    return F.when(any_, each).otherwise(F.array().cast("array<string>"))


def without_shadowed(df: DataFrame, key: str, weak: Column) -> DataFrame:
    """Drops weak rows (aggregators' copies) whose key a strong row has too."""
    strong = df.where(~weak & F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()
    return df.where(~weak).unionByName(df.where(weak).join(strong, F.col(key) == F.col("_k"), "left_anti"))


def retry_set(failures: DataFrame, entities: DataFrame, key: str, transient: Column) -> DataFrame:
    """The entities with a transient failure, once each."""
    return entities.join(failures.where(transient).select(key).distinct(), key, "left_semi")


def replace_failures(failures: DataFrame, retried: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Failures of what wasn't retried, and those of the retry."""
    return failures.join(retried.select(key).distinct(), key, "left_anti").unionByName(fresh)
