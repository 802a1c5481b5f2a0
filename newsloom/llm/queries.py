"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import history, knn, mixing, names, pieces, scans, spans, tokens
from newsloom.session import table


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.most_similar(spark, table(spark, sf_dir, "chunks"), "id", "embedding_json")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbour_pairs(p1_neighbours(spark, sf_dir))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = pieces.split_oversized(table(spark, sf_dir, "articles"), "id", "text").select(F.lit("article").alias("item_kind"), "*")
    chunks = pieces.split_oversized(table(spark, sf_dir, "chunks"), "id", "content").select(F.lit("chunk").alias("item_kind"), "*")
    return articles.unionByName(chunks)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("seq = 0").select("item_kind", "item_id", "cut_level")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = names.load_roster(table(spark, sf_dir, "station_records"))
    open_ = F.trim(F.coalesce("canonical_station_id", F.lit(""))) == ""
    aliases = table(spark, sf_dir, "station_aliases").where(open_).select(F.lit("alias").alias("record_kind"), F.col("alias").alias("record_key"), F.col("alias").alias("name"))
    docs = table(spark, sf_dir, "docs").where(open_).select(F.lit("doc").alias("record_kind"), F.col("doc_id").alias("record_key"), F.col("station_name").alias("name"))
    typed = aliases.unionByName(docs)
    linked = typed.join(names.resolve_names(spark, typed, "name", roster), "name").select("record_kind", "record_key", "station_id")
    return linked.unionByName(names.roster_variants(spark, roster).select(F.lit("station").alias("record_kind"), "record_key", "station_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise_lines(scans.page_noise(spark, table(spark, sf_dir, "docs"), "doc_id", "content_text")[0])


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.readable_paragraphs(*scans.page_noise(spark, table(spark, sf_dir, "docs"), "doc_id", "content_text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = history.History(spark)
    history.accept_archive(past, table(spark, sf_dir, "docs"), "doc_id", "file_sha256")
    return history.run_batches(past, table(spark, sf_dir, "audit_documents"), "batch_no", "record_no", "content_sha256", "document_url")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(spark, table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    sizes = mixing.token_sizes(spark, table(spark, sf_dir, "documents"))
    return mixing.mix_sources(spark, sizes, table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).records


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares(spark)


#: A mixture half as large again as the largest exact one: sources reach their caps and pass their weight on.
_STRETCH = 1.5


def _large_mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.mix_sources(spark, mixing.token_sizes(spark, table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"), stretch=_STRETCH)


def p8_mix_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _large_mixture(spark, sf_dir).records


def p8_shares_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _large_mixture(spark, sf_dir).shares(spark)


def p8_allotments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source gives to the large mixture where sizes are characters, which SQL can count."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.trim("source").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    shares = mixing.mix_sources(spark, sizes, table(spark, sf_dir, "mix_targets"), stretch=_STRETCH).shares(spark)
    return shares.select("source", F.col("available_tokens").alias("available"), F.round("allotted_tokens", 1).alias("allotted"), "clamped")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(spark, table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_report(p9_found(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_mix_large": p8_mix_large,
    "p8_shares_large": p8_shares_large,
    "p8_allotments": p8_allotments,
    "p9_found": p9_found,
    "p9_shared": p9_shared,
}
#: Brute force in SQL, for the small tables of the correctness check.
ORACLES: dict[str, str] = {
    "p1_found": """
WITH p AS (SELECT id, TRY_CAST(TRY_CAST(embedding_json AS JSON) AS DOUBLE[]) AS v FROM chunks),
u AS (SELECT id, v FROM p WHERE len(v) = 64 AND NOT list_contains(list_transform(v, lambda x: x IS NULL), true) AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM s WHERE c >= 0.85) WHERE r <= 5)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM k""",
    "p8_allotments": f"""
WITH a AS (SELECT t.source, t.target_share AS w, t.max_repeats AS m, CAST(coalesce(sum(length(d.text)), 0) AS BIGINT) AS available FROM mix_targets t LEFT JOIN documents d ON trim(d.source) = t.source GROUP BY ALL),
c AS (SELECT *, available * m AS cap, available * m / w AS r FROM a WHERE w > 0 AND available > 0),
t AS (SELECT least({_STRETCH} * min(r), sum(cap)) AS total FROM c),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c),
l AS (SELECT coalesce(first((total - used) / rest ORDER BY r, source) FILTER ((total - used) / rest <= r), 1e300) AS level FROM o, t)
SELECT a.source, a.available, round(coalesce(least(c.cap, l.level * c.w), 0), 1) AS allotted, coalesce(l.level * c.w > c.cap, false) AS clamped FROM a LEFT JOIN c USING (source), l""",
    "p9_found": """
WITH w AS (SELECT doc_id, p, hash(substring(text, p + 1, 160)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 159)) AS p FROM documents WHERE length(text) >= 160)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w SEMI JOIN s USING (h)),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 160 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_pos, CAST(max(p) + 160 AS INTEGER) AS end_pos FROM g GROUP BY doc_id, run""",
    "p9_shared": """
WITH w AS (SELECT doc_id, p, hash(substring(text, p + 1, 160)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 159)) AS p FROM documents WHERE length(text) >= 160)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w SEMI JOIN s USING (h)),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 160 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
r AS (SELECT doc_id, run, max(p) + 160 - min(p) AS n FROM g GROUP BY doc_id, run), t AS (SELECT doc_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_spans, coalesce(t.c, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN coalesce(t.c, 0) / length(d.text) ELSE 0.0 END AS shared_part FROM documents d LEFT JOIN t USING (doc_id)""",
}
