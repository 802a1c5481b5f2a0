"""Full text queries, question rows, hybrid search over articles, and the whole commands."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.vectors import json_vector
from newsloom.operators import fulltext, retrieval, scoring
from newsloom.plans import commands
from newsloom.plans.catalog import Catalog
from newsloom.plans.domain_queries import _KINDS, BOOK
from newsloom.session import own_dir, staged, table

C = Catalog()

# -- full text ------------------------------------------------------------------------------------
_FTS = {
    "all words": "antenna deficit", "either": '"fiscal year" OR refinanc*', "column": "title:board NOT deficit", "near": "NEAR(board budget, 5)", "nested": '(tower OR transmitter) AND "public radio" NOT podcast',
}
_TOKS = r"SELECT id, regexp_extract_all(strip_accents(lower(coalesce(title, ''))), '[\p{L}\p{N}]+') AS tt, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS bt FROM articles"
_word = lambda w: f"(list_contains(tt, '{w}') OR list_contains(bt, '{w}'))"
_phrase = lambda p: "(" + " OR ".join(f"contains(' ' || array_to_string({c}, ' ') || ' ', ' {p} ')" for c in ("tt", "bt")) + ")"
_prefix = lambda p: "(" + " OR ".join(f"len(list_filter({c}, lambda x: starts_with(x, '{p}'))) > 0" for c in ("tt", "bt")) + ")"
_nearby = "(" + " OR ".join(f"len(list_filter(range(1, len({c}) + 1), lambda i: {c}[i] = 'board' AND (list_contains(list_slice({c}, greatest(i - 6, 1), i + 6), 'budget')))) > 0" for c in ("tt", "bt")) + ")"
_FTS_SQL = {
    "all words": f"{_word('antenna')} AND {_word('deficit')}", "either": f"{_phrase('fiscal year')} OR {_prefix('refinanc')}", "column": f"list_contains(tt, 'board') AND NOT {_word('deficit')}", "near": _nearby,
    "nested": f"({_word('tower')} OR {_word('transmitter')}) AND ({_phrase('public radio')} AND NOT {_word('podcast')})",
}


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The index of titles and texts, written once a session and folder."""
    path = f"{own_dir(spark)}/articles-index-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    return fulltext.kept_index(spark, path, lambda: fulltext.token_index(table(spark, d, "articles"), "id", ["title", "text"]))


@C.query(f"WITH t AS MATERIALIZED ({_TOKS}) " + " UNION ALL ".join(f"SELECT '{n}' AS query, id FROM t WHERE {cond}" for n, cond in _FTS_SQL.items()))
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    """Five queries against one stored index of titles and texts."""
    index = _index(spark, d)
    return reduce(DataFrame.unionByName, [fulltext.search(index, q).select(F.lit(n).alias("query"), "id") for n, q in _FTS.items()])


@C.query(f"SELECT a.id, a.title FROM articles a JOIN ({_TOKS}) t USING (id) WHERE {_FTS_SQL['all words']} ORDER BY id LIMIT 20")
def fts_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a search, by id, at most 20."""
    hits = fulltext.search(_index(spark, d), _FTS["all words"])
    return fulltext.first_rows(table(spark, d, "articles"), "id", hits, 20).select("id", "title")


# -- hybrid search --------------------------------------------------------------------------------
_VECTORS = """v AS (SELECT id, article_id, TRY_CAST(TRY_CAST(embedding_json AS JSON) AS DOUBLE[]) AS e FROM chunks),
u AS (SELECT * FROM v WHERE len(e) = 64 AND NOT list_contains(list_transform(e, lambda x: x IS NULL), true) AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
s AS (SELECT u.id, u.article_id, round(list_cosine_similarity(u.e, q.e), 6) AS score FROM u, (SELECT e FROM u ORDER BY id LIMIT 1) q),
b AS (SELECT article_id AS id, max(score) AS score FROM s GROUP BY article_id),
n AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, max(score) OVER () AS top FROM (SELECT * FROM b ORDER BY score DESC, id LIMIT 16)),
near AS (SELECT id, score, rank, 1 AS list_no FROM n WHERE score >= greatest(0.12, 0.55 * top) OR rank <= 3)"""
_HIT = lambda t: f"(contains(lower(coalesce(title,'')), '{t}') OR contains(lower(coalesce(text,'')), '{t}'))"


@C.query(f"""WITH {_VECTORS},
r AS (SELECT a.id, a.published_at, round(CASE WHEN contains(lower(coalesce(title,'')), 'network audit') THEN 0.08 WHEN contains(lower(coalesce(text,'')), 'network audit') THEN 0.06
 WHEN CAST({_HIT('antenna')} AS INTEGER) + CAST({_HIT('deficit')} AS INTEGER) >= 2 THEN 0.02 END, 6) AS bonus FROM articles a WHERE id IN (SELECT id FROM b)),
l AS (SELECT id, round(bonus + (SELECT max(score) FROM near), 6) AS score, row_number() OVER (ORDER BY bonus DESC, published_at DESC NULLS LAST, id DESC) AS rank, 0 AS list_no FROM r WHERE bonus IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_no, rank) AS rn FROM (SELECT * FROM l WHERE rank <= 4 UNION ALL SELECT id, score, rank, list_no FROM near))
SELECT id, score, list_no FROM x WHERE rn = 1 ORDER BY list_no, rank, id LIMIT 16""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Articles that words bring back, just above the best vector hit, then those nearest by their best chunk."""
    chunks = table(spark, d, "chunks").select("id", "article_id", json_vector("embedding_json", 64).alias("e")).where("e is not null")
    first = chunks.orderBy("id").select("e").limit(1).first()
    scored = retrieval.score_vectors(chunks, F.col("e"), first["e"] if first else [0.0] * 64)
    best = staged(spark, scored.groupBy(F.col("article_id").alias("id")).agg(F.max("score").alias("score")), "best")
    near = retrieval.threshold_backfill(best, 16)
    articles = table(spark, d, "articles").join(best.select("id"), "id", "left_semi")
    rescue = retrieval.lexical_rescue(articles, ["network audit"], ["antenna", "deficit"], 0.0, 16).withColumn("score", F.round(F.col("score") + near.agg(F.max("score")).scalar(), 6))
    return retrieval.merge_lists([rescue, near], 16).select("id", "score", "list_no")


# -- questions over archived documents ------------------------------------------------------------
_ASKED, _MARK, _STOCK, _SECTIONS = ("antenna", "deficit", "renewal"), ("percent", "million"), ("confidential draft",), ("reserve fell", "agreement had lapsed")
_rate = lambda c: "(" + " + ".join([*(f"4 * CAST(contains(lower({c}), '{w}') AS INTEGER)" for w in _ASKED), *(f"2 * CAST(contains(lower({c}), '{w}') AS INTEGER)" for w in _MARK)]) + f" - 6 * CAST(contains(lower({c}), '{_STOCK[0]}') AS INTEGER))"


@C.query(rf"""WITH RECURSIVE p AS (SELECT doc_id AS id, generate_subscripts(ps, 1) AS pi, trim(regexp_replace(unnest(ps), '[\s\x{{00A0}}]+', ' ', 'g')) AS para FROM (SELECT doc_id, string_split_regex(content_text, '\n\s*\n') AS ps FROM docs WHERE content_text IS NOT NULL)),
s AS (SELECT id, pi, CASE WHEN length(para) <= 700 THEN [para] ELSE string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS ss FROM p WHERE para <> ''),
r(id, pi, ss, i, held, done) AS (SELECT id, pi, ss, 1, ss[1], CAST(NULL AS VARCHAR) FROM s
 UNION ALL SELECT id, pi, ss, i + 1, CASE WHEN length(held) + 1 + length(ss[i + 1]) <= 700 THEN held || ' ' || ss[i + 1] ELSE ss[i + 1] END, CASE WHEN length(held) + 1 + length(ss[i + 1]) <= 700 THEN NULL ELSE held END FROM r WHERE i < len(ss)),
c AS (SELECT id, done AS t, 0 AS more FROM r WHERE done IS NOT NULL UNION ALL SELECT id, held, 0 FROM r WHERE i = len(ss)
 {" ".join(rf"UNION ALL SELECT doc_id, trim(regexp_replace(substring(content_text, strpos(content_text, '{x}'), 1200), '[\s\x{{00A0}}]+', ' ', 'g')), 8 FROM docs WHERE strpos(content_text, '{x}') > 0" for x in _SECTIONS)}),
g AS (SELECT id, CASE WHEN length(t) > 900 THEN substring(t, 1, 900) || '...' ELSE t END AS t, {_rate('t')} + more AS s FROM c),
b AS (SELECT id, max(s) AS best, least(2, count(DISTINCT substring(t, 1, 120))) AS parts FROM g WHERE s > 0 GROUP BY id),
h AS (SELECT doc_id, report_year, lower(coalesce(title, '') || ' ' || coalesce(content_text, '')) AS hay, coalesce(best, 0) AS best, coalesce(parts, 0) AS parts FROM docs LEFT JOIN b ON b.id = doc_id)
SELECT doc_id, CAST({" + ".join(f"4 * CAST(contains(hay, '{w}') AS INTEGER)" for w in _ASKED)} + 3 * best + CAST({" OR ".join(f"contains(hay, '{m}')" for m in _MARK)} AS INTEGER) + CASE WHEN report_year > 0 THEN 2 ELSE 0 END AS INTEGER) AS score, CAST(parts AS INTEGER) AS excerpts FROM h""")
def question_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every document's score for a question, with its two best excerpts counted."""
    rows = scoring.row_scores(table(spark, d, "docs"), "title", "content_text", F.col("report_year"), _ASKED, _MARK, _STOCK, _SECTIONS)
    return rows.select("doc_id", "score", F.coalesce(F.size(F.coalesce("excerpts", F.array().cast("array<struct<excerpt:string,score:int>>"))), F.lit(0)).alias("excerpts"))


# -- whole commands -------------------------------------------------------------------------------
@C.query()
def search_command(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "article_id", "content", json_vector("embedding_json", 64).alias("embedding")).where("embedding is not null")
    first = chunks.orderBy("id").select("embedding").limit(1).first()
    return commands.search_chunks(table(spark, d, "articles"), chunks, "What is the story about the antenna deficit?", first["embedding"] if first else [0.0] * 64)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rules = commands.FeedRules(BOOK, aggregators=("search.example",), job_phrases=("vacancy", "help wanted"))
    items = table(spark, d, "feed_items").withColumn("published", F.col("fetched_at").cast("timestamp"))
    return commands.rank_feed(items, rules, F.lit("2024-06-01").cast("timestamp"), 24 * 365)


@C.query()
def feed_command(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("item_id", "title", "best_score", "bucket", "duplicate_count")


@C.query()
def stories_command(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "feed_items").where("item_id % 4 = 0").select("title")
    return commands.stories_to_send(_ranked(spark, d), told, commands.FeedRules(BOOK).stopwords)


@C.query()
def audit_command(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "audit_documents").select("record_no", "batch_no", "station_id", "title", "document_url")
    seen = found.where("batch_no <= 6").select(commands.urls.page_key("document_url").alias("url"))
    return commands.audit_scan(found.where("batch_no > 6"), seen, _KINDS, "audit|financial|report").select("record_no", "station_id", "kind", "year", "latest")


@C.query()
def station_command(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs")
    top = docs.where("canonical_station_id <> ''").groupBy("canonical_station_id").count().orderBy(F.desc("count"), "canonical_station_id").first()
    return commands.station_page(docs, top[0] if top else "", ["deficit", "renewal"])


@C.query(r"""WITH p AS (SELECT url, title, fetched_at AS date_gmt, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS page FROM articles WHERE fetched_at >= '2024-06'),
m AS (SELECT regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS page, coalesce(nullif(regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS path, id * 17 % 101 AS value, id FROM articles WHERE id % 2 = 0),
e AS (SELECT page, arg_max(value, id) AS v FROM m GROUP BY page), l AS (SELECT path, arg_max(value, id) AS v FROM m GROUP BY path)
SELECT p.url, p.title, p.date_gmt, coalesce(e.v, l.v, 0) AS value FROM p LEFT JOIN e ON p.page = e.page LEFT JOIN l ON l.path = coalesce(nullif(regexp_replace(regexp_extract(trim(p.url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')""")
def newsletter_command(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    posts = articles.select("url", "title", F.col("fetched_at").alias("date_gmt"))
    metrics = articles.where("id % 2 = 0").select("url", (F.col("id") * 17 % 101).alias("value"), F.col("id").alias("pos"))
    return commands.newsletter_posts(posts, metrics, "2024-06").select("url", "title", "date_gmt", "value")


QUERIES, ORACLES = C.queries, C.oracles
