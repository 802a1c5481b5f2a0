"""Canonical entities by shared address, alias tables, unambiguous tokens, wildcard lookup, roster keys, validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import alias_forms, has_any_term, name_tokens, tokens
from newsloom.functions.urls import page_key
from newsloom.operators.joins import word_grams


def canonical_rank(name: Column, penalties: Sequence[str]) -> Column:
    """Names with few penalised marks before short ones before the alphabet."""
    marks = sum((F.lower(name).contains(p).cast("int") for p in penalties), F.lit(0))
    return F.struct(marks.alias("p"), F.length(name).alias("l"), F.lower(name).alias("n"))


def canonical_by_address(df: DataFrame, id_col: str, name_col: str, url_col: str, penalties: Sequence[str] = ()) -> DataFrame:
    """``id, canonical_id``: rows with one page address are one entity, named by its best ranked row."""
    keyed = df.withColumn("_key", F.when(F.length(F.trim(url_col)) > 0, page_key(url_col)))
    best = keyed.where("_key is not null").groupBy("_key").agg(F.min_by(id_col, F.struct(canonical_rank(F.col(name_col), penalties), F.col(id_col))).alias("canonical_id"))
    return keyed.join(best, "_key", "left").select(F.col(id_col), F.coalesce("canonical_id", F.col(id_col)).alias("canonical_id"))


def alias_table(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``alias, target`` of all forms of the names that mean one entity only."""
    forms = df.where(F.col(name_col).isNotNull()).select(F.explode(alias_forms(name_col)).alias("alias"), F.col(id_col).alias("target")).distinct()
    return forms.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1").select("alias", "target")


def unambiguous_tokens(df: DataFrame, id_col: str, name_col: str, generic: Sequence[str]) -> DataFrame:
    """``token, target`` of the words that only one entity's name holds."""
    words = df.select(F.explode(F.array_distinct(name_tokens(name_col, generic))).alias("token"), F.col(id_col).alias("target")).distinct()
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1").select("token", "target")


def lookup_like(aliases: DataFrame, docs: DataFrame, pattern: str, alias: str, target: str, name: str, doc_columns: Sequence[str]) -> DataFrame:
    """``target, name`` by LIKE over the aliases, else (if none) over the documents' columns."""
    like = f"%{pattern.lower()}%"
    first = aliases.where(F.lower(alias).like(like) & (F.col(target) != "")).groupBy(F.col(target).alias("target")).agg(F.min(name).alias("name"))
    cond = F.lit(False)
    for c in doc_columns:
        cond = cond | F.lower(F.coalesce(c, F.lit(""))).like(like)
    second = docs.where(cond & (F.col(target) != "")).groupBy(F.col(target).alias("target")).agg(F.min(name).alias("name"))
    return first.unionByName(second.where(first.agg(F.count(F.lit(1))).scalar() == 0))


def roster_keys(df: DataFrame, name_col: str) -> DataFrame:
    """``key_type, key``: call signs (with and without band) and normalised names of a roster."""
    is_call = F.trim(name_col).rlike("^[KW][A-Z0-9]{2,6}(-[A-Z0-9]{1,4})?$")
    calls = df.where(is_call).select(F.lit("call_sign").alias("key_type"), F.explode(F.array_distinct(F.array(F.upper(F.trim(name_col)), F.regexp_replace(F.upper(F.trim(name_col)), "-?(FM|TV|AM)$", "")))).alias("key"))
    names = df.where(~is_call & (F.length(F.trim(name_col)) > 0)).select(F.lit("org_name").alias("key_type"), F.array_join(name_tokens(name_col), " ").alias("key"))
    return calls.unionByName(names).where("key <> ''").distinct()


def validate_config(df: DataFrame, id_col: str, url_col: str, enabled: Column) -> DataFrame:
    """One row of counters and lists about a configuration table."""
    has = F.length(F.trim(F.coalesce(url_col, F.lit("")))) > 0
    good = F.coalesce(F.lower(F.trim(url_col)).rlike(r"^https?://[^/\s]+"), F.lit(False))
    ids = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    counts = df.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(enabled).alias("enabled"), F.count_if(has & ~good).alias("malformed_urls"),
        F.count_if(enabled & ~has).alias("enabled_without_url"), F.count_if(~enabled & has).alias("disabled_with_url"),
    )
    both = counts.unionByName(ids, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def config_issues(df: DataFrame, id_col: str, name_col: str, url_col: str, enabled: Column) -> DataFrame:
    """``issue, id, name, url``: the entries behind the counters - duplicate ids, bad addresses, switched off with one, on without."""
    has = F.length(F.trim(F.coalesce(url_col, F.lit("")))) > 0
    good = F.coalesce(F.lower(F.trim(url_col)).rlike(r"^https?://[^/\s]+"), F.lit(False))
    shown = lambda rows, issue: rows.select(F.lit(issue).alias("issue"), F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(url_col).alias("url"))
    twice = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("issue"), F.col(id_col).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("url"))
    parts = [shown(df.where(has & ~good), "malformed_url"), shown(df.where(~enabled & has), "disabled_with_url"), shown(df.where(enabled & ~has), "enabled_without_url")]
    return reduce(DataFrame.unionByName, parts, twice)


def headline_names(roster: DataFrame, name_col: str, core: Sequence[str]) -> DataFrame:
    """``name, is_call``: what headlines may call the stations of a roster - call signs without band, or names with a core term."""
    name = F.trim(F.col(name_col))
    call = F.regexp_extract(name, "^([KW][A-Z]{2,4})(?:-(?:FM|TV|DT|AM|LP))?$", 1)
    named = roster.select(F.when(call != "", call).when(has_any_term(name, core), F.lower(name)).alias("name"), (call != "").alias("is_call"))
    return named.where("name is not null").distinct()


def in_headlines(df: DataFrame, id_col: str, text: str, names: DataFrame) -> DataFrame:
    """The ids of texts that name a station: a call sign in capitals, or a whole name in any case, by equi-joins on runs of words."""
    calls = df.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\b([KW][A-Z]{2,4})\b"), 1))).alias("name")).join(names.where("is_call").select("name"), "name", "left_semi")
    keys = names.where("not is_call").select(F.array_join(tokens("name"), " ").alias("term"), F.size(tokens("name")).alias("n")).where("n > 0").distinct()
    lengths = sorted(r["n"] for r in keys.select("n").distinct().collect())  # as many as names have words
    said = df.select(id_col, tokens(text).alias("_w")).select(id_col, F.explode(word_grams(F.col("_w"), lengths)).alias("term")).join(keys.select("term"), "term", "left_semi")
    return calls.select(id_col).unionByName(said.select(id_col)).distinct()


def skip_reason(enabled: Column, url: Column) -> Column:
    return F.when(~enabled, "disabled entry").when(F.length(F.trim(F.coalesce(url, F.lit("")))) == 0, "enabled without page_url")
