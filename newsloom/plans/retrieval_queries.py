"""Retrieval: lexical branches, gates, vectors, hybrid, full text, chunking, upserts, health."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import collapse, highlight
from newsloom.operators import dedupe, retrieval as R
from newsloom.operators.fulltext import kept_index
from newsloom.operators.ranking import top_k_per_group
from newsloom.plans.catalog import Catalog
from newsloom.session import own_dir, table

C = Catalog()
_ART = "lower(coalesce(title,''))"
_TXT = "lower(coalesce(text,''))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select(F.transform("embedding", lambda x: x.cast("double")).alias("e")).first()
    return row["e"] if row else [0.0] * 64


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("vec_id <> 0").select(F.col("vec_id").alias("id"), "label", "embedding")
    return R.score_vectors(rows, F.col("embedding"), _query_vector(spark, d)).drop("embedding")


_SCORES = """SELECT e.vec_id AS id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0"""


@C.query(f"SELECT label, id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rn FROM ({_SCORES})) WHERE rn = 1 ORDER BY score DESC, id LIMIT 8")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    best = _scored(spark, d).groupBy("label").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("x")).select("label", "x.id", "x.score")
    return best.orderBy(F.desc("score"), "id").limit(8)


@C.query(f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, max(score) OVER () AS top FROM (SELECT * FROM ({_SCORES}) ORDER BY score DESC, id LIMIT 50))
SELECT id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE score >= greatest(0.12, 0.55 * top) OR rank <= 3""")
def vector_threshold_backfill(spark: SparkSession, d: str) -> DataFrame:
    return R.threshold_backfill(_scored(spark, d), 50).select("id", "score", "rank")


@C.query(f"SELECT id, published_at FROM articles WHERE ({_ART} LIKE '%community radio%' OR {_TXT} LIKE '%community radio%') ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 60")
def lexical_phrase_articles(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_branch(table(spark, d, "articles"), ["community radio"], 60).select("id", "published_at")


@C.query(f"SELECT id, published_at FROM articles WHERE ({_ART} LIKE '%antenna%' OR {_TXT} LIKE '%antenna%' OR {_ART} LIKE '%deficit%' OR {_TXT} LIKE '%deficit%') AND published_at >= '2023-06' AND published_at <= '2024-02-10' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 100")
def lexical_term_articles(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_branch(table(spark, d, "articles"), ["antenna", "deficit"], 100, "2023-06", "2024-02-10").select("id", "published_at")


@C.query("SELECT id, published_at FROM articles WHERE published_at >= '2024-01-01' AND published_at <= '2024-03-31'")
def date_window_articles(spark: SparkSession, d: str) -> DataFrame:
    return R.in_date_window(table(spark, d, "articles"), "published_at", "2024-01-01", "2024-03-31").select("id", "published_at")


@C.query(f"""WITH a AS (SELECT id, 0 AS branch FROM articles WHERE {_ART} LIKE '%network audit%' OR {_TXT} LIKE '%network audit%' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 60),
b AS (SELECT id, 1 AS branch FROM (SELECT id FROM articles WHERE {_ART} LIKE '%antenna%' OR {_TXT} LIKE '%antenna%' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 60) WHERE (SELECT count(DISTINCT id) FROM a) < 80),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT id, 2 AS branch FROM (SELECT id FROM articles ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 40) WHERE (SELECT count(DISTINCT id) FROM ab) < 64)
SELECT id, min(branch) AS branch FROM (SELECT * FROM ab UNION ALL SELECT * FROM c) GROUP BY id""")
def candidate_gated_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    recent = a.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(40)
    return R.gated_union([(R.lexical_branch(a, ["network audit"], 60), None), (R.lexical_branch(a, ["antenna"], 60), 80), (recent, 64)], "id")


@C.query(r"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS c FROM documents WHERE text IS NOT NULL),
r(doc_id,c,n,idx,s,e) AS (
  SELECT doc_id, c, length(c), 0, 0, CASE WHEN length(c)<=1400 THEN length(c) ELSE (SELECT CASE WHEN p>300 THEN p ELSE 1400 END FROM (SELECT 1400 - strpos(reverse(substring(c,1,1400)),' ') AS p)) END FROM t WHERE length(c)>0
  UNION ALL
  SELECT doc_id, c, n, idx+1, s2, CASE WHEN s2+1400>=n THEN n WHEN strpos(w,' ')>0 AND s2+1400-strpos(reverse(w),' ')>s2+300 THEN s2+1400-strpos(reverse(w),' ') ELSE s2+1400 END
  FROM (SELECT doc_id,c,n,idx, greatest(0,e-220) AS s2, substring(c, greatest(0,e-220)+1, 1400) AS w FROM r WHERE e<n))
SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, trim(substring(c, s+1, e-s)) AS content FROM r""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.window_chunks(table(spark, d, "documents"), "doc_id", "text", size=1400, overlap=220)


@C.query(r"""WITH RECURSIVE p AS (SELECT id, generate_subscripts(ps, 1) AS pi, trim(regexp_replace(unnest(ps), '[\s\x{00A0}]+', ' ', 'g')) AS para FROM (SELECT id, string_split_regex(text, '\n\s*\n') AS ps FROM articles WHERE text IS NOT NULL)),
s AS (SELECT id, pi, CASE WHEN length(para) <= 700 THEN [para] ELSE string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS ss FROM p WHERE para <> ''),
r(id, pi, ss, i, held, done) AS (SELECT id, pi, ss, 1, ss[1], CAST(NULL AS VARCHAR) FROM s
 UNION ALL SELECT id, pi, ss, i + 1, CASE WHEN length(held) + 1 + length(ss[i + 1]) <= 700 THEN held || ' ' || ss[i + 1] ELSE ss[i + 1] END, CASE WHEN length(held) + 1 + length(ss[i + 1]) <= 700 THEN NULL ELSE held END FROM r WHERE i < len(ss)),
o AS (SELECT id, pi, i, 0 AS final, done AS content FROM r WHERE done IS NOT NULL UNION ALL SELECT id, pi, i, 1, held FROM r WHERE i = len(ss))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pi, i, final) - 1 AS INTEGER) AS chunk_index, content FROM o""")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.paragraph_chunks(table(spark, d, "articles"), "id", "text")


@C.query("""SELECT source, count(*) AS n_docs, count(text) AS n_texts, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source""")
def docs_by_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("text").alias("n_texts"), F.sum("n_chars").alias("chars"))


@C.query("""SELECT count(*) AS n_docs, count(*) FILTER (extracted_ok = 1) AS n_extracted, count(DISTINCT nullif(canonical_station_id, '')) AS n_stations, count(*) FILTER (canonical_station_id = '') AS n_unresolved, count(DISTINCT nullif(report_year, 0)) AS n_years FROM docs""")
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs")
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("extracted_ok") == 1).alias("n_extracted"), F.countDistinct(F.nullif("canonical_station_id", F.lit(""))).alias("n_stations"),
        F.count_if(F.col("canonical_station_id") == "").alias("n_unresolved"), F.countDistinct(F.nullif("report_year", F.lit(0))).alias("n_years"),
    )


@C.query("""WITH c AS (SELECT id + 20 AS id, CASE WHEN id % 6 = 0 THEN url || '?v=2' ELSE url END AS url, title FROM articles WHERE id % 3 = 0), l AS (SELECT url, max(id) AS id FROM c GROUP BY url)
SELECT id, url, title FROM articles WHERE url NOT IN (SELECT url FROM l) UNION ALL SELECT c.id, c.url, c.title FROM c JOIN l ON c.url = l.url AND c.id = l.id""")
def upsert_articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("id", "url", "title")
    changes = a.where("id % 3 = 0").select((F.col("id") + 20).alias("id"), F.when(F.col("id") % 6 == 0, F.concat("url", F.lit("?v=2"))).otherwise(F.col("url")).alias("url"), "title")
    return dedupe.upsert(a, changes, "url", "id")


@C.query("""SELECT article_id, chunk_index, length(content) AS n FROM chunks WHERE article_id % 5 <> 0 UNION ALL SELECT article_id, CAST(0 AS INTEGER), CAST(max(length(content)) AS BIGINT) FROM chunks WHERE article_id % 5 = 0 GROUP BY article_id""")
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("article_id", "chunk_index", F.length("content").cast("long").alias("n"))
    fresh = rows.where("article_id % 5 = 0").groupBy("article_id").agg(F.lit(0).alias("chunk_index"), F.max("n").alias("n"))
    return dedupe.replace_children(rows, fresh, "article_id")


@C.query("""SELECT c.article_id, a.title, count(*) AS n_chunks, CAST(sum(length(c.content)) AS BIGINT) AS chars FROM chunks c JOIN articles a ON a.id = c.article_id GROUP BY c.article_id, a.title""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "chunks").groupBy("article_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("chars"))
    return per.join(table(spark, d, "articles").select(F.col("id").alias("article_id"), "title"), "article_id").select("article_id", "title", "n_chunks", "chars")


@C.query("""SELECT article_id, id AS chunk_id, content_length FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY content_length DESC, id) AS rn FROM (SELECT id, article_id, length(content) AS content_length FROM chunks WHERE content IS NOT NULL)) WHERE rn <= 2""")
def top_chunks_per_article(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("content is not null").select("article_id", F.col("id").alias("chunk_id"), F.length("content").cast("long").alias("content_length"))
    return top_k_per_group(rows, ["article_id"], [F.desc("content_length"), F.asc("chunk_id")], 2).drop("rank")


_TOK = "(SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+') AS ts FROM documents)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The index of all texts, written once a session and folder and sorted by token; queries read their words' postings."""
    path = f"{own_dir(spark)}/documents-index-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    return kept_index(spark, path, lambda: R.inverted_index(table(spark, d, "documents"), "doc_id", "text"))


@C.query(f"SELECT id FROM {_TOK} WHERE list_contains(ts, 'antenna') AND list_contains(ts, 'deficit')")
def fts_and(spark: SparkSession, d: str) -> DataFrame:
    return R.match_all(_index(spark, d), ["antenna", "deficit"])


@C.query(f"SELECT id FROM {_TOK} WHERE (list_contains(ts, 'antenna') OR list_contains(ts, 'bylaw'))")
def fts_or(spark: SparkSession, d: str) -> DataFrame:
    return R.match_any(_index(spark, d), ["antenna", "bylaw"])


@C.query(f"SELECT id FROM {_TOK} WHERE list_contains(ts, 'antenna') AND NOT list_contains(ts, 'bylaw')")
def fts_not(spark: SparkSession, d: str) -> DataFrame:
    return R.match_without(_index(spark, d), ["antenna"], ["bylaw"])


@C.query(f"SELECT DISTINCT id FROM {_TOK} WHERE len(list_filter(ts, lambda x: starts_with(x, 'refinanc'))) > 0")
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return R.match_prefix(_index(spark, d), "refinanc")


@C.query(f"SELECT id FROM {_TOK} WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' fiscal year closed ')")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return R.match_phrase(_index(spark, d), ["fiscal", "year", "closed"])


@C.query(r"""WITH p AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ps FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ps, list_transform(ps, lambda w: regexp_matches(lower(w), '(^|[^a-z0-9])antenna($|[^a-z0-9])|(^|[^a-z0-9])deficit($|[^a-z0-9])')) AS hs FROM p),
a AS (SELECT *, list_position(hs, true) AS pos, greatest(1, list_position(hs, true) - 10) AS b FROM h WHERE list_contains(hs, true))
SELECT doc_id, CASE WHEN b > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(range(b, least(b + 20, len(ps) + 1)), lambda i: CASE WHEN hs[i] THEN '[' || ps[i] || ']' ELSE ps[i] END), ' ') AS snip FROM a""")
def fts_snippet(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", R.snippet(F.col("text"), ["antenna", "deficit"]).alias("snip"))
    return rows.where("snip is not null")


@C.query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(content_text, '[\s\x{00A0}]+', ' ', 'g')) AS t FROM docs WHERE content_text <> ''),
h AS (SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?i)(reserve fell[^.]{0,220}\.)', 1), ''), nullif(regexp_extract(t, '(?i)(going concern[^.]{0,220}\.)', 1), ''), nullif(regexp_extract(t, '(?i)(shortfall[^.]{0,220}\.)', 1), ''), nullif(regexp_extract(t, '^(.{24,259}?[.!?])(?: |$)', 1), ''), substring(t, 1, 260)) AS h FROM t)
SELECT doc_id, CASE WHEN length(h) > 260 THEN substring(h, 1, 257) || '...' ELSE h END AS highlight FROM h""")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docs").where("content_text is not null and content_text <> ''")
    return rows.select("doc_id", highlight("content_text", ["reserve fell", "going concern", "shortfall"]).alias("highlight"))


@C.query(r"""SELECT id, length(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) AS n, 'short text' AS reason FROM articles WHERE length(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) < 700""")
def short_page_rejects(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.operators.reports import reject_log

    n = F.length(collapse("text")).cast("long")
    return reject_log(table(spark, d, "articles").withColumn("n", n), F.when(F.col("n") < 700, "short text"))[1].select("id", "n", "reason")


@C.query(f"""WITH s AS (SELECT id, published_at, round(0.5 + CASE WHEN contains({_ART}, 'network audit') THEN 0.08 WHEN contains({_TXT}, 'network audit') THEN 0.06
 WHEN (CAST(contains({_ART},'antenna') OR contains({_TXT},'antenna') AS INTEGER) + CAST(contains({_ART},'deficit') OR contains({_TXT},'deficit') AS INTEGER)) >= 2 THEN 0.02 END, 6) AS score FROM articles)
SELECT id, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, published_at DESC NULLS LAST, id DESC LIMIT 4""")
def lexical_rescue(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_rescue(table(spark, d, "articles"), ["network audit"], ["antenna", "deficit"], 0.5, 8).select("id", "score")


QUERIES, ORACLES = C.queries, C.oracles
