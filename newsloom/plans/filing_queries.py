"""Filings, rosters, configuration upkeep, page candidates and roll-ups over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import entities, filings, ranking, scoring
from newsloom.plans.catalog import Catalog, rows_as
from newsloom.session import table

C = Catalog()


@C.query("""SELECT key_type, count(DISTINCT key) AS n FROM (
 SELECT 'call_sign' AS key_type, unnest([upper(trim(alias)), regexp_replace(upper(trim(alias)), '-?(FM|TV|AM)$', '')]) AS key FROM station_aliases WHERE regexp_matches(trim(alias), '^[KW][A-Z0-9]{2,6}(-[A-Z0-9]{1,4})?$')
 UNION ALL SELECT 'org_name', array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(alias), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''), ' ') FROM station_aliases WHERE NOT regexp_matches(trim(alias), '^[KW][A-Z0-9]{2,6}(-[A-Z0-9]{1,4})?$') AND length(trim(alias)) > 0) WHERE key <> '' GROUP BY key_type""")
def roster_summary(spark: SparkSession, d: str) -> DataFrame:
    return filings.roster_summary(entities.roster_keys(table(spark, d, "station_aliases"), "alias"))


@C.query("""SELECT alias, regexp_matches(upper(trim(alias)), '^[KW][A-Z0-9]{2,6}(-[A-Z0-9]{1,4})?$') AS valid FROM station_aliases""")
def call_sign_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "station_aliases").select("alias", filings.is_call_sign(F.col("alias")).alias("valid"))


@C.query("""SELECT item_id, nullif(trim(CAST(item_id AS VARCHAR)), '') AS file_number, nullif(trim(source_call_sign), '') AS call_sign, nullif(trim(link), '') AS detail_url FROM public_files_items""")
def dynamic_columns(spark: SparkSession, d: str) -> DataFrame:
    row = F.create_map(F.lit("Callsign"), F.col("source_call_sign"), F.lit(" FILE NO "), F.col("item_id").cast("string"), F.lit("Facility Id"), F.lit(""), F.lit("Link"), F.col("link"))
    rows = table(spark, d, "public_files_items").select("item_id", row.alias("row"))
    return rows.select("item_id", *[c for c, n in zip(filings.typed_row(F.col("row")), filings.SYNONYMS) if n in ("file_number", "call_sign", "detail_url")])


_ORG = r"array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'the','inc','llc','corp','of','and','foundation','friends')), ' ')"


@C.query(f"""WITH c AS (SELECT DISTINCT alias AS k FROM station_aliases WHERE regexp_matches(alias, '^[KW][A-Z]{{3,4}}$')), n AS (SELECT DISTINCT {_ORG.format(c='station_name')} AS k FROM station_records WHERE station_name IS NOT NULL), f AS (SELECT DISTINCT nullif(regexp_replace(proceedings[1], '[^0-9]', '', 'g'), '') AS k FROM ecfs_items WHERE len(matched_call_signs) > 1)
SELECT filing_id, CASE WHEN c.k IS NOT NULL THEN 'call_sign' WHEN f.k IS NOT NULL THEN 'facility_id' WHEN n.k IS NOT NULL THEN 'org_name' END AS matched_by FROM ecfs_items e LEFT JOIN c ON e.matched_call_signs[1] = c.k LEFT JOIN f ON nullif(regexp_replace(e.proceedings[1], '[^0-9]', '', 'g'), '') = f.k LEFT JOIN n ON {_ORG.format(c='e.filers[1]')} = n.k""")
def filing_match(spark: SparkSession, d: str) -> DataFrame:
    aliases, roster = table(spark, d, "station_aliases"), table(spark, d, "station_records")
    rows = table(spark, d, "ecfs_items").select("filing_id", F.get("matched_call_signs", F.lit(0)).alias("call_sign"), F.get("proceedings", F.lit(0)).alias("facility_id"), text.org_key(F.get("filers", F.lit(0))).alias("org_name"))
    calls = aliases.where(F.col("alias").rlike("^[KW][A-Z]{3,4}$")).select("alias")
    names = roster.where("station_name is not null").select(text.org_key("station_name").alias("k"))
    # Dockets that concern several stations stand for the facilities a filing may name.
    dockets = table(spark, d, "ecfs_items").where(F.size("matched_call_signs") > 1).select(text.digits(F.get("proceedings", F.lit(0))).alias("k"))
    return filings.match_roster(rows, calls, dockets, names).select("filing_id", "matched_by")


@C.query("""WITH b AS (SELECT station_id, arg_min(page_url, page_url) AS u FROM audit_documents WHERE page_url IS NOT NULL AND station_id IS NOT NULL GROUP BY 1)
SELECT s.station_id, CASE WHEN length(trim(coalesce(s.page_url,''))) = 0 AND u IS NOT NULL THEN u ELSE s.page_url END AS page_url, CASE WHEN length(trim(coalesce(s.page_url,''))) = 0 AND u IS NOT NULL THEN false ELSE enabled END AS enabled,
 CASE WHEN length(trim(coalesce(s.page_url,''))) = 0 AND u IS NOT NULL THEN trim(coalesce(notes,'') || ' [found]') ELSE notes END AS notes FROM station_records s LEFT JOIN b USING (station_id)""")
def apply_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "audit_documents").where("page_url is not null and station_id is not null").select("station_id", F.col("page_url").alias("url"), F.lit(0).alias("score"))
    out = filings.apply_candidates(table(spark, d, "station_records"), found, "[found]")
    return out.select("station_id", "page_url", "enabled", "notes")


@C.query("""SELECT s.station_id, count(*) AS documents, arg_min(a.title, a.record_no) AS first_document FROM (SELECT DISTINCT station_id FROM station_records WHERE NOT enabled) s JOIN audit_documents a USING (station_id) GROUP BY 1""")
def disabled_review(spark: SparkSession, d: str) -> DataFrame:
    return filings.review_rows(table(spark, d, "station_records"), table(spark, d, "audit_documents"), "enabled", "station_id", "record_no", "title")


@C.query("""SELECT lower(regexp_extract(trim(page_url), '^([A-Za-z]+://[^/?#]+)', 1)) AS root, CAST(max(5 * (CASE WHEN contains(lower(page_url), 'radio') THEN 1 ELSE 0 END + CASE WHEN contains(lower(page_url), 'public') THEN 1 ELSE 0 END)) AS INTEGER) AS score
 FROM (SELECT regexp_extract(trim(page_url), '^([A-Za-z]+://[^/?#]+)', 1) AS page_url FROM audit_documents WHERE page_url IS NOT NULL) WHERE page_url <> '' GROUP BY 1 ORDER BY score DESC, root LIMIT 4""")
def candidate_domains(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "audit_documents").where("page_url is not null")
    return filings.candidate_domains(pages, "page_url", F.array(F.lit("radio"), F.lit("public")))


@C.query("""SELECT page_url, score FROM (SELECT page_url, CAST(CASE WHEN contains(u,'audit') THEN 2 ELSE 0 END + CASE WHEN contains(u,'report') THEN 2 ELSE 0 END + CASE WHEN len(string_split(regexp_replace(page_url,'^[a-z]+://',''),'/')) > 2 THEN 1 ELSE 0 END + CASE WHEN starts_with(u,'https://') THEN 1 ELSE 0 END AS INTEGER) AS score
 FROM (SELECT DISTINCT page_url, lower(page_url) AS u FROM audit_documents WHERE page_url IS NOT NULL)) ORDER BY score DESC, page_url LIMIT 25""")
def page_candidates_topn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audit_documents").where("page_url is not null").select("page_url").distinct()
    scored = rows.select("page_url", scoring.page_score(F.col("page_url"), F.lit(""), ("audit", "report"), ()).alias("score"))
    return ranking.top_k(scored, [F.desc("score"), F.asc("page_url")], 25)


@C.query("""SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM audit_documents WHERE status = 'failed') AS failed, (SELECT count(DISTINCT station_id) FROM audit_documents) AS stations, (SELECT count(*) FROM feed_items) AS items""")
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_documents")
    return filings.health_rollup(
        table(spark, d, "docs").agg(rows_as("docs")), a.where("status = 'failed'").agg(rows_as("failed")), a.agg(F.countDistinct("station_id").alias("stations")), table(spark, d, "feed_items").agg(rows_as("items"))
    )


@C.query("""SELECT item_id, regexp_extract(trim(link), '[?&]id=([^&#]*)', 1) AS id_param, CASE WHEN starts_with(lower(link), 'https') THEN 'https' ELSE 'http' END AS scheme FROM public_files_items WHERE link IS NOT NULL""")
def link_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "public_files_items").where("link is not null")
    return rows.select("item_id", F.coalesce(urls.parameter(F.trim("link"), "id"), F.lit("")).alias("id_param"), F.when(F.lower("link").startswith("https"), "https").otherwise("http").alias("scheme"))


@C.query("""SELECT status, file_ext, count(*) AS n, count(DISTINCT station_id) AS stations, count(*) FILTER (flags <> '') AS flagged FROM audit_documents GROUP BY status, file_ext""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_documents").groupBy("status", "file_ext").agg(rows_as("n"), F.countDistinct("station_id").alias("stations"), F.count_if(F.col("flags") != "").alias("flagged"))


@C.query("""SELECT flag, count(*) AS n, count(DISTINCT station_id) AS stations FROM (SELECT station_id, unnest(list_distinct(string_split(flags, ';'))) AS flag FROM audit_documents WHERE flags <> '') GROUP BY flag""")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audit_documents").where("flags <> ''").select("station_id", F.explode(F.array_distinct(F.split("flags", ";"))).alias("flag"))
    return rows.groupBy("flag").agg(rows_as("n"), F.countDistinct("station_id").alias("stations"))


@C.query("""SELECT keyword, count(*) AS n FROM (SELECT unnest(list_distinct(matched_keywords)) AS keyword FROM ecfs_items UNION ALL SELECT unnest(list_distinct(matched_keywords)) FROM public_files_items) WHERE keyword IS NOT NULL GROUP BY keyword""")
def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "ecfs_items").select("matched_keywords").unionByName(table(spark, d, "public_files_items").select("matched_keywords"))
    return both.select(F.explode(F.array_distinct("matched_keywords")).alias("keyword")).where("keyword is not null").groupBy("keyword").agg(rows_as("n"))


@C.query("""SELECT item_id FROM public_files_items WHERE try_strptime(published_at, '%Y-%m-%d') IS NULL OR try_strptime(published_at, '%Y-%m-%d') >= TIMESTAMP '2024-06-01'""")
def meeting_recency(spark: SparkSession, d: str) -> DataFrame:
    day = F.try_to_date("published_at", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("try_to_date(published_at, 'yyyy-MM-dd')")
    return table(spark, d, "public_files_items").where(day.isNull() | (day >= F.lit("2024-06-01").cast("date"))).select("item_id")


_HAS = "length(trim(coalesce(page_url,''))) > 0"


@C.query(f"""SELECT 'duplicate_id' AS issue, station_id AS id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS url FROM station_records GROUP BY station_id HAVING count(*) > 1
UNION ALL SELECT 'malformed_url', station_id, station_name, page_url FROM station_records WHERE {_HAS} AND NOT coalesce(regexp_matches(lower(trim(page_url)), '^https?://[^/\\s]+'), false)
UNION ALL SELECT 'disabled_with_url', station_id, station_name, page_url FROM station_records WHERE NOT enabled AND {_HAS} UNION ALL SELECT 'enabled_without_url', station_id, station_name, page_url FROM station_records WHERE enabled AND NOT {_HAS}""")
def config_issues(spark: SparkSession, d: str) -> DataFrame:
    return entities.config_issues(table(spark, d, "station_records"), "station_id", "station_name", "page_url", F.col("enabled"))


@C.query(r"""WITH n AS (SELECT DISTINCT CASE WHEN regexp_matches(trim(alias), '^[KW][A-Z]{2,4}(-(FM|TV|DT|AM|LP))?$') THEN regexp_extract(trim(alias), '^([KW][A-Z]{2,4})', 1) WHEN regexp_matches(lower(trim(alias)), '(^|[^a-z0-9])(public radio|community radio|public media)($|[^a-z0-9])') THEN lower(trim(alias)) END AS name, regexp_matches(trim(alias), '^[KW][A-Z]{2,4}(-(FM|TV|DT|AM|LP))?$') AS is_call FROM station_aliases),
k AS (SELECT DISTINCT array_to_string(regexp_extract_all(name, '[a-z0-9]+'), ' ') AS term FROM n WHERE NOT is_call AND name IS NOT NULL),
t AS (SELECT item_id, title, ' ' || array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') || ' ' AS w FROM feed_items)
SELECT DISTINCT item_id FROM (SELECT item_id FROM (SELECT item_id, unnest(regexp_extract_all(title, '\b([KW][A-Z]{2,4})\b', 1)) AS name FROM t) JOIN n USING (name) WHERE is_call UNION ALL SELECT item_id FROM t JOIN k ON term <> '' AND contains(w, ' ' || term || ' '))""")
def headline_stations(spark: SparkSession, d: str) -> DataFrame:
    """Feed items whose headline names a station of the roster."""
    names = entities.headline_names(table(spark, d, "station_aliases"), "alias", ("public radio", "community radio", "public media"))
    return entities.in_headlines(table(spark, d, "feed_items"), "item_id", "title", names)


@C.query("""WITH r AS (SELECT record_no, lower(coalesce(confidence, '')) AS c, coalesce(try_cast(regexp_extract(title, '(20[0-9][0-9])', 1) AS INTEGER), 0) AS y, coalesce(station_name, '') AS s, coalesce(title, '') AS t, CASE WHEN contains(lower(title), 'audit') THEN 0 WHEN contains(lower(title), 'report') THEN 1 ELSE 2 END AS k FROM audit_documents)
SELECT record_no FROM r ORDER BY k, y DESC, CASE c WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, s, t, record_no LIMIT 60""")
def document_priority(spark: SparkSession, d: str) -> DataFrame:
    """The 60 most important documents found (none is marked latest here)."""
    rows = table(spark, d, "audit_documents").select("record_no", "confidence", "station_name", "title", F.lit(False).alias("latest"), F.regexp_extract("title", "(20[0-9][0-9])", 1).try_cast("int").alias("year"), F.when(F.lower("title").contains("audit"), "audit").when(F.lower("title").contains("report"), "report").alias("kind"))
    return ranking.top_k(rows, [*ranking.document_order(("audit", "report")), F.asc("record_no")], 60).select("record_no")


@C.query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '[\s\x{00A0}]+', ' ', 'g')), ''), nullif(regexp_extract(regexp_replace(file_path, '[?#].*$', ''), '([^/]*)$', 1), ''), file_path) AS shown FROM docs WHERE file_path IS NOT NULL""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where("file_path is not null").select("doc_id", text.document_title(F.coalesce("title", F.lit("")), "file_path").alias("shown"))


QUERIES, ORACLES = C.queries, C.oracles
