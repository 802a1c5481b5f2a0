"""Whole commands put together from operators: search, feed triage, audit scan, station pages, newsletter.

Each is one lazy plan (or a few); the question, the lexicons and the dates are arguments.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import dedupe, joins, ranking, retrieval, scoring, similarity, state
from newsloom.session import staged

#: Words a question is asked with, not about; a default that callers may replace.
QUESTION_WORDS = frozenset("a an and are about any as at be by did do does find for from give had has have how in is it its me of on or show story tell that the there these this to was were what when where which who why will with".split())


# -- questions ------------------------------------------------------------------------------------
def question_words(question: str, least: int = 3, asked: frozenset[str] = QUESTION_WORDS) -> list[str]:
    """The words a question is about, in order."""
    words = re.findall(r"[a-z0-9]+", question.lower())
    return list(dict.fromkeys(w for w in words if len(w) >= least and w not in asked))


def phrases_of(question: str, most: int = 4) -> list[str]:
    """Phrases worth looking for: what is quoted, what follows ``about``, the last three and two words, all of them."""
    found = [q.strip().lower() for q in re.findall(r"[\"“]([^\"”]{4,})[\"”]", question)]
    about = re.search(r"\babout\s+(?:the\s+)?(.+?)[?.!]*$", question.lower())
    if about:
        found.append(re.sub(r"[^a-z0-9 ]+", "", about.group(1)).strip())
    words = question_words(question)
    found += [" ".join(words[-3:]) if len(words) >= 3 else "", " ".join(words[-2:]) if len(words) >= 2 else "", " ".join(words)]
    return list(dict.fromkeys(p for p in found if len(p) >= 4))[:most]


def asks_for_trend(question: str) -> bool:
    return bool(re.search(r"\b(trend|over time|year by year|history|since|between \d{4}|changed?|growth|decline)\b", question.lower()))


# -- search ---------------------------------------------------------------------------------------
def search_chunks(articles: DataFrame, chunks: DataFrame, question: str, vector: Sequence[float], k: int = 8, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The ``k`` best articles for a question, each with its best chunk: words first, then vectors.

    ``chunks``: ``id, article_id, content, embedding`` (array of numbers). Without any vector hit there is no result.
    """
    words, phrases = question_words(question)[:6], phrases_of(question)
    dated = retrieval.in_date_window(articles, "published_at", date_from, date_to)
    branches = [(retrieval.lexical_branch(dated, [p], max(10 * k, 60)), None) for p in phrases]
    if words:
        branches.append((retrieval.lexical_branch(dated, words, max(10 * k, 60)), max(10 * k, 60)))
    recent = dated.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(max(8 * k, 40))
    branches.append((recent, max(8 * k, 40) if branches else None))
    candidates = retrieval.gated_union(branches, "id").select(F.col("id").alias("article_id"))
    scored = retrieval.score_vectors(chunks.join(candidates, "article_id", "left_semi"), F.col("embedding"), vector).where("score > 0")
    best = scored.groupBy("article_id").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("x"))
    best = best.select(F.col("article_id").alias("id"), F.col("x.id").alias("chunk_id"), F.col("x.score").alias("score"))
    near = retrieval.threshold_backfill(best.select("id", "score"), k)
    top = near.agg(F.max("score").alias("s"))
    rescue = retrieval.lexical_rescue(dated.join(best.select("id"), "id", "left_semi"), phrases, words, 0.0, k)
    rescue = rescue.withColumn("score", F.round(F.col("score") + top.scalar(), 6)).where("score is not null")
    merged = retrieval.merge_lists([rescue, near], k)
    shown = merged.join(best.select("id", "chunk_id"), "id").join(articles.select("id", "url", "title", "published_at"), "id")
    return shown.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").select("list_no", "rank", "score", "id", "chunk_id", "url", "title", "published_at", "content").orderBy("list_no", "rank", "id")


# -- feeds ----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class FeedRules:
    book: scoring.Rulebook
    aggregators: Sequence[str] = ()
    suppressed: Sequence[str] = ()
    job_phrases: Sequence[str] = ()
    stopwords: Sequence[str] = ("a", "an", "and", "the", "of", "for", "in", "on", "to")


def rank_feed(items: DataFrame, rules: FeedRules, now: Column, hours: int, seen: DataFrame | None = None) -> DataFrame:
    """Feed items as ranked stories: windowed, filtered, scored, merged by address or headline, aggregators' copies out.

    ``items``: ``item_id, feed_title, title, link, summary, published`` (a timestamp or null).
    """
    rows = state.overlap_window(items, "published", now, now, hours)
    rows = rows.withColumn("domain", urls.host("link")).withColumn("url", urls.normalized("link"))
    title = F.coalesce("title", F.lit(""))
    rows = rows.where(~F.coalesce(F.col("domain").isin(*rules.suppressed), F.lit(False)) if rules.suppressed else F.lit(True))
    if rules.job_phrases:
        rows = rows.where(~text.has_any_term(title, rules.job_phrases))
    if seen is not None:
        rows = state.unseen(rows, seen.withColumnRenamed(seen.columns[0], "url"), "url")
    weak = F.coalesce(F.col("domain").isin(*rules.aggregators), F.lit(False)) if rules.aggregators else F.lit(False)
    fp = F.nullif(text.fingerprint(title, rules.stopwords), F.lit(""))
    rows = rows.withColumn("weak", weak).withColumn("fp", fp).withColumn("key", F.coalesce(F.when(weak, F.concat(F.lit("headline|"), fp)), "url", F.concat_ws("|", "domain", "fp"), F.lit("")))
    body = text.plain_text(F.concat_ws(" ", title, "summary"))
    scored = scoring.score(rows, body, rules.book)
    merged = dedupe.merge_groups(scored, "key", "item_id", "score", "published", "feed_title", ["item_id", "title", "link", "domain", "fp", "weak", "bucket"])
    kept = joins.without_shadowed(merged, "fp", F.col("weak"))
    return kept.orderBy(F.desc("best_score"), F.desc_nulls_last("latest"), "item_id")


def stories_to_send(ranked: DataFrame, told: DataFrame, stopwords: Sequence[str], k: int = 40, groups: Sequence[Sequence[str]] = ()) -> DataFrame:
    """The best of the ranked items that don't resemble what was told recently (``told``: ``title``), one a story.

    ``groups``: milestone words; titles of different milestones tell different stories.
    """
    sign = {"words": similarity.word_set("title", stopwords), "marks": similarity.milestones("title", groups) if groups else F.array().cast("array<int>"), "nums": similarity.amounts("title")}
    rows = staged(ranked.sparkSession, ranked.where("bucket <> 'low'").select("item_id", "title", "link", "best_score").withColumns(sign), "ranked")
    memory = told.where("title is not null").select("title").withColumns(sign).drop("title")
    rule = {"jaccard": 0.55, "shared": 4, "many": 5, "contained": 0.85, "extra": ["marks"], "apart": ["nums"]}
    fresh = staged(ranked.sparkSession, ranking.top_k(similarity.unlike_recent(rows, memory, "words", least=4, **rule), [F.desc("best_score"), F.asc("item_id")], k), "fresh")
    heads = similarity.greedy_stories(ranked.sparkSession, fresh, "item_id", [-F.col("best_score")], "words", **rule).where("pos = story").select(F.col("pos").alias("item_id"))
    return fresh.join(heads, "item_id", "left_semi").drop(*sign)


# -- audit documents ------------------------------------------------------------------------------
def audit_scan(found: DataFrame, seen: DataFrame, kinds: Sequence[tuple[str, Sequence[str]]], hints: str) -> DataFrame:
    """New candidate documents, each address once (the last discovery counts), the latest of each station marked."""
    rows = found.where(F.lower(F.concat_ws(" ", "title", "document_url")).rlike(hints)).withColumn("url", urls.page_key("document_url"))
    rows = dedupe.keep_first(rows, ["station_id", "url"], ["record_no"], last=True)
    rows = state.unseen(rows, seen.withColumnRenamed(seen.columns[0], "url"), "url")
    kind = scoring.ordered_label(F.col("title"), kinds, "other")
    rank = F.coalesce(*[F.when(kind == name, i) for i, (name, _) in enumerate(kinds)], F.lit(len(kinds)))
    from newsloom.functions.dates import latest_year

    rows = rows.withColumn("kind", kind).withColumn("kind_rank", rank).withColumn("year", F.coalesce(latest_year(F.coalesce("title", F.lit("")), F.coalesce("document_url", F.lit(""))), F.lit(0)))
    latest = ranking.best_with_ties(rows.select("record_no", "station_id", "kind_rank", "year"), ["station_id"], [F.col("kind_rank"), -F.col("year")])
    return rows.join(latest.select("record_no", F.lit(True).alias("latest")), "record_no", "left").withColumn("latest", F.coalesce("latest", F.lit(False)))


def station_page(docs: DataFrame, station_id: str, words: Sequence[str], k: int = 12) -> DataFrame:
    """A station's documents for a question: at most two a year, each with the sentence that answers best."""
    own = docs.where(F.col("canonical_station_id") == station_id)
    scored = own.withColumn("score", scoring.question_score(F.coalesce("content_text", F.lit("")), words, (), ()))
    best = ranking.capped_ranking(scored.select("doc_id", "title", "report_year", "score"), "report_year", [F.desc("score"), F.desc("report_year"), F.asc("doc_id")], 2, k)
    said = scoring.best_sentences(own.where("content_text is not null"), "doc_id", "content_text", words, ())
    return best.join(said, "doc_id", "left").orderBy(F.desc("score"), F.desc("report_year"), "doc_id")


def newsletter_posts(posts: DataFrame, metrics: DataFrame, since: str) -> DataFrame:
    """Posts since a day with their metric (same page, else same path, else 0), best first.

    ``posts``: ``url, title, date_gmt``; ``metrics``: ``url, value, pos``.
    """
    keyed = lambda df: df.withColumn("page", urls.page_key("url")).withColumn("path", urls.path("url"))
    out = joins.two_tier(keyed(posts.where(F.col("date_gmt") >= since)), keyed(metrics).select("page", "path", "value", "pos"), ("page", "path"), "value", "pos")
    return out.drop("page", "path").orderBy(F.desc("value"), F.desc("date_gmt"), "url")


