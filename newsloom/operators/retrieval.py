"""Retrieval over articles and chunks: lexical branches, gated union, vector search, hybrid, full text, chunking."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.functions.text import any_of, bounded, collapse, tokens
from newsloom.functions.vectors import cosine


# -- chunking -------------------------------------------------------------------------------------
def window_spans(length: int, blanks: Sequence[int], size: int, overlap: int, least: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``size``, each but the last ending at the last blank that leaves it over ``least`` characters.

    ``blanks``: the sorted positions of the blanks. A span starts ``overlap`` before the end of the one before.
    """
    start = 0
    while length - start > size:
        last = bisect_left(blanks, start + size) - 1
        stop = blanks[last] if last >= 0 and blanks[last] - start > least else start + size
        yield start, stop
        start = max(0, stop - overlap)
    yield start, length


def window_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1_400, overlap: int = 220, least: int = 300) -> DataFrame:
    """``id, chunk_index, content``: overlapping windows over texts with their white space collapsed.

    Null, empty and blank texts have no
    chunks; a chunk that is blank has no row. ``overlap`` must be under ``least``, or windows would not advance.
    """
    if not 0 <= overlap < least < size:
        raise ValueError("0 <= overlap < least < size is needed")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, place, content = [], [], []
            for i, text in zip(pdf[id_col], pdf["_text"]):
                text = " ".join(text.split())
                blanks = [m.start() for m in re.finditer(" ", text)] if len(text) > size else ()
                pieces = [c for c in (text[a:b].strip(" ") for a, b in window_spans(len(text), blanks, size, overlap, least)) if c]
                owner += [i] * len(pieces)
                place += range(len(pieces))
                content += pieces
            yield pd.DataFrame({id_col: pd.Series(owner, dtype=pdf[id_col].dtype), "chunk_index": np.array(place, np.int32), "content": pd.Series(content, dtype=object)})

    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text"))
    return rows.mapInPandas(cut, f"{id_col} {dict(df.dtypes)[id_col]}, chunk_index int, content string")


def packed_paragraphs(text: Column | str, size: int = 700) -> Column:
    """The paragraphs of a text in order; longer ones as runs of whole sentences of at most ``size`` where sentences allow."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), collapse), lambda p: p != "")
    fits = lambda held, s: F.length(held) + 1 + F.length(s) <= size

    def add(done: Column, s: Column) -> Column:
        """The last run grows by the sentence if it may; else the sentence begins a run."""
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(" "), s)))
        return F.when(F.size(done) == 0, F.array(s)).when(fits(last, s), grown).otherwise(F.concat(done, F.array(s)))

    runs = lambda p: F.aggregate(F.split(p, r"(?<=[.!?])\s+"), F.array().cast("array<string>"), add)
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(runs(p))))


def paragraph_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 700) -> DataFrame:
    """``id, chunk_index, content``: all in the JVM; texts without a paragraph have no row."""
    return df.select(id_col, F.posexplode(packed_paragraphs(F.col(text_col), size)).alias("chunk_index", "content"))


# -- lexical and vector branches ------------------------------------------------------------------
def lexical_branch(articles: DataFrame, terms: Sequence[str], k: int, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The newest ``k`` articles whose title or text holds any of the terms; dates are compared as text."""
    hit = any_of([F.lower(F.coalesce(c, F.lit(""))).contains(t) for t in terms for c in ("title", "text")])
    out = in_date_window(articles.where(hit), "published_at", date_from, date_to)
    return out.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(k)


def in_date_window(df: DataFrame, column: str, date_from: str | None, date_to: str | None, inclusive_day: bool = False) -> DataFrame:
    """Text dates between two bounds, compared as text: a bare last day excludes its own times unless ``inclusive_day``."""
    if date_from:
        df = df.where(F.col(column) >= date_from)
    if date_to:
        df = df.where(F.col(column) <= (date_to + "~" if inclusive_day else date_to))
    return df


def gated_union(branches: Sequence[tuple[DataFrame, int | None]], id_col: str) -> DataFrame:
    """``id, branch``: branches in order of priority; one with a gate adds rows only while fewer distinct ids came before.

    The counts are scalar subqueries of the plan.
    """
    out: DataFrame | None = None
    for i, (branch, gate) in enumerate(branches):
        rows = branch.select(F.col(id_col).alias("id"), F.lit(i).alias("branch"))
        if out is not None and gate is not None:
            rows = rows.where(out.agg(F.countDistinct("id")).scalar() < gate)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("id").agg(F.min("branch").alias("branch"))


def score_vectors(df: DataFrame, vector: Column, query: Sequence[float], places: int = 6) -> DataFrame:
    """Similarity to one query vector, which is a literal of the plan: no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("score", F.round(cosine(vector, q), places))


def threshold_backfill(scored: DataFrame, k: int, floor: float = 0.12, share: float = 0.55, least: int = 3) -> DataFrame:
    """The best rows over ``max(floor, share * top)``, filled up to ``min(least, k)`` from below; at most ``k``."""
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))  # at most k rows
    best = F.max("score").over(W.partitionBy())
    return ranked.withColumn("bar", F.greatest(F.lit(floor), best * share)).where((F.col("score") >= F.col("bar")) | (F.col("rank") <= min(least, k))).drop("bar")


def lexical_rescue(articles: DataFrame, phrases: Sequence[str], terms: Sequence[str], top: float, k: int, most: int = 4) -> DataFrame:
    """``id, score, rank`` of at most ``min(k, most)`` articles that words alone bring back, scored just above ``top``.

    A phrase in the title adds 0.08, in the text 0.06; enough terms add 0.01 each, up to 0.05.
    """
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    in_title, in_body = any_of([title.contains(p) for p in phrases]), any_of([body.contains(p) for p in phrases])
    hits = sum(((title.contains(t) | body.contains(t)).cast("int") for t in terms), F.lit(0))
    bonus = F.when(in_title, 0.08).when(in_body, 0.06).when(hits >= min(2, len(terms)), F.least(F.lit(0.05), hits * 0.01))
    scored = articles.select("id", "published_at", F.round(F.lit(top) + bonus, 6).alias("score")).where("score is not null")
    best = scored.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), F.desc("id")).limit(min(k, most))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), F.desc("id"))))  # at most `most` rows


def merge_lists(lists: Sequence[DataFrame], k: int) -> DataFrame:
    """``id, score, list_no``: the lists one after another, each id where it came first, cut at ``k``."""
    rows = None
    for i, part in enumerate(lists):
        part = part.select("id", "score", F.lit(i).alias("list_no"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("id").agg(F.min_by(F.struct("score", "list_no", "rank"), F.struct("list_no", "rank")).alias("x")).select("id", "x.*")
    return first.orderBy("list_no", "rank", "id").limit(k)


# -- full text ------------------------------------------------------------------------------------
def inverted_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``token, id, positions``; accents count as separators, case doesn't."""
    words = df.select(F.col(id_col).alias("id"), F.posexplode(tokens(text_col)).alias("pos", "token"))
    return words.groupBy("token", "id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def match_all(index: DataFrame, words: Sequence[str]) -> DataFrame:
    return index.where(F.col("token").isin(*words)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(words))).select("id")


def match_any(index: DataFrame, words: Sequence[str]) -> DataFrame:
    return index.where(F.col("token").isin(*words)).select("id").distinct()


def match_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return index.where(F.col("token").startswith(prefix)).select("id").distinct()


def match_without(index: DataFrame, words: Sequence[str], banned: Sequence[str]) -> DataFrame:
    return match_all(index, words).join(match_any(index, banned), "id", "left_anti")


def match_phrase(index: DataFrame, words: Sequence[str]) -> DataFrame:
    """Ids with the words one after another: each word's positions, moved to the phrase's start, must meet."""
    place = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(f"{w}"), F.array(*[F.lit(j) for j, v in enumerate(words) if v == w]))])
    moved = index.where(F.col("token").isin(*words)).select("id", "positions", F.explode(F.element_at(place, F.col("token"))).alias("at"))
    starts = moved.select("id", "at", F.explode("positions").alias("p")).select("id", "at", (F.col("p") - F.col("at")).alias("start"))
    return starts.groupBy("id", "start").agg(F.countDistinct("at").alias("n")).where(F.col("n") == len(words)).select("id").distinct()


def snippet(text: Column, words: Sequence[str], length: int = 20) -> Column:
    """The window of words with the first hit, hits in brackets."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    hit = lambda w: F.lower(w).rlike("|".join(bounded(x) for x in words))
    at = F.array_position(F.transform(parts, hit), F.lit(True)).cast("int")
    start = F.greatest(F.lit(1), at - length // 2)
    shown = F.transform(F.slice(parts, start, F.lit(length)), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("… ")).otherwise(F.lit("")), F.array_join(shown, " ")))
