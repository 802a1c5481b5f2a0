"""Scalar functions over the domain tables: text, addresses, dates, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls
from newsloom.functions.vectors import id_of
from newsloom.plans.catalog import Catalog
from newsloom.session import table

C = Catalog()
STOP = ("a", "an", "and", "the", "of", "for", "in", "on", "to", "what", "means")


@C.query(r"""SELECT id, trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g')) AS title_clean, length(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) AS n_clean FROM articles""")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", text.collapse("title").alias("title_clean"), F.length(text.collapse("text")).cast("long").alias("n_clean"))


@C.query(r"""SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug FROM articles""")
def slugify_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("id", text.slug("title").alias("slug"))


@C.query(r"""SELECT item_id, array_to_string(list_slice(list_filter(regexp_extract_all(lower(trim(regexp_replace(title, '^(.*) - .*$', '\1'))), '[a-z0-9]+'),
 lambda w: w NOT IN ('a','an','and','the','of','for','in','on','to','what','means')), 1, 12), ' ') AS fp FROM feed_items""")
def title_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_items").select("item_id", text.fingerprint("title", STOP).alias("fp"))


@C.query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(summary,
 '&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&apos;',''''),'&ndash;','–'),'&mdash;','—'),'&rsquo;','’'),'&lsquo;','‘'),'&hellip;','…'),'&amp;','&'),
 '<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS summary_text FROM feed_items""")
def plain_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_items").select("item_id", text.plain_text("summary").alias("summary_text"))


@C.query(r"""SELECT item_id, CASE WHEN length(summary) <= 120 THEN summary ELSE regexp_replace(substring(summary, 1, 119), ' [^ ]*$', '') || '…' END AS short FROM feed_items""")
def shortened_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_items").select("item_id", text.shortened("summary", 120).alias("short"))


@C.query(r"""SELECT doc_id, CASE WHEN length(content_text) < 1 THEN true ELSE
 (length(regexp_replace(substring(content_text,1,300), '[^\p{L}]', '', 'g')) < 40 OR length(regexp_replace(substring(content_text,1,300), '[\x00-\x7F]', '', 'g')) > greatest(10, floor(length(substring(content_text,1,300))/10))) END AS low FROM docs WHERE content_text IS NOT NULL""")
def low_quality_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").where("content_text is not null")
    return docs.select("doc_id", F.when(F.length("content_text") < 1, True).otherwise(text.low_quality("content_text")).alias("low"))


@C.query(r"""WITH t AS (SELECT doc_id, content_text AS c, strpos(regexp_replace(content_text, '(?s)reserve fell.*$', chr(1)), chr(1)) AS p FROM docs)
SELECT doc_id, trim(regexp_replace(substring(c, greatest(p-80,1), p - greatest(p-80,1) + 120), '[\s\x{00A0}]+', ' ', 'g')) AS snip FROM t WHERE p > 0""")
def snippet_first_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("doc_id", text.around("content_text", "reserve fell", 80, 120).alias("snip")).where("snip is not null")


@C.query(r"""SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(title, '\b([KW][A-Z]{2,4}(?:-(?:FM|TV|DT|AM|LP|LD|CD))?)\b', 1))), ',') AS calls FROM public_files_items WHERE title IS NOT NULL""")
def call_sign_presence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "public_files_items").where("title is not null")
    return rows.select("item_id", F.array_join(F.array_sort(text.call_signs("title")), ",").alias("calls"))


@C.query(r"""SELECT station_id, array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(station_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'the','inc','llc','corp','of','and','foundation','friends')), ' ') AS org_key FROM station_records""")
def organisation_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "station_records").select("station_id", text.org_key("station_name").alias("org_key"))


@C.query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[A-Za-z0-9]{1,5}$', ''), '[-_]+', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS file_title FROM docs WHERE file_path IS NOT NULL""")
def title_from_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where("file_path is not null").select("doc_id", text.title_from_filename("file_path").alias("file_title"))


_NORMAL = r"""lower(regexp_extract(trim(link), '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_replace(regexp_extract(trim(link), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') ||
 coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(link), '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x,'=',1)) NOT IN
 ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','mc_cid','mc_eid'))), '&'), ''), '')"""


@C.query(f"SELECT item_id, {_NORMAL} AS url FROM feed_items WHERE link IS NOT NULL")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_items").where("link is not null").select("item_id", urls.normalized("link").alias("url"))


@C.query(r"""SELECT host, count(*) AS n, count(DISTINCT path) AS n_paths FROM (SELECT regexp_replace(lower(regexp_extract(trim(link), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
 coalesce(nullif(regexp_replace(regexp_extract(trim(link), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS path FROM feed_items WHERE link IS NOT NULL) GROUP BY host""")
def url_host_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feed_items").where("link is not null").select(urls.host("link").alias("host"), urls.path("link").alias("path"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_paths"))


@C.query(r"""SELECT DISTINCT trim(document_url) AS url FROM audit_documents WHERE regexp_matches(trim(document_url), '(?i)^https?://[^/?#\s]+') AND lower(document_url) LIKE '%audit%'""")
def url_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audit_documents").where(urls.is_web_address("document_url") & F.lower("document_url").contains("audit"))
    return rows.select(F.trim("document_url").alias("url")).distinct()


@C.query(r"""SELECT doc_id, list_max(list_concat(
 list_transform(regexp_extract_all(upper(coalesce(title,'')), 'FYE?[ _-]?(\d{2})(?:[^0-9]|$)', 1), lambda y: CAST(y AS INTEGER) + CASE WHEN CAST(y AS INTEGER) <= 69 THEN 2000 ELSE 1900 END),
 list_transform(regexp_extract_all(coalesce(title,''), '(?:^|[^0-9])(20\d{2})(?:[^0-9]|$)', 1), lambda y: CAST(y AS INTEGER)))) AS year_title, report_year FROM docs""")
def report_year_infer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("doc_id", dates.latest_year(F.coalesce("title", F.lit(""))).alias("year_title"), "report_year")


@C.query("""SELECT record_no, substring(sha256(coalesce(station_id,'') || '|' || coalesce(document_url,'') || '|' || coalesce(title,'') || '|' || coalesce(file_ext,'')), 1, 20) AS key FROM audit_documents""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_documents").select("record_no", id_of("station_id", "document_url", "title", "file_ext", length=20).alias("key"))


@C.query("""SELECT event_id, strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m-%d') AS first_day, strftime(date_trunc('month', ts) - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day FROM events""")
def previous_month_bounds(spark: SparkSession, d: str) -> DataFrame:
    first, last = dates.month_bounds(F.col("ts").cast("timestamp"), "UTC")
    return table(spark, d, "events").select("event_id", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


@C.query("""SELECT gate, count(*) AS n FROM (SELECT CASE WHEN strftime(ts, '%H') IN ('06','07') THEN 'morning' WHEN strftime(ts, '%H') IN ('14','15') THEN 'update' END AS gate FROM events) WHERE gate IS NOT NULL GROUP BY gate""")
def local_trigger_gate(spark: SparkSession, d: str) -> DataFrame:
    clock = lambda hours: [f"{h:02d}:{m:02d}" for h in hours for m in range(60)]
    gate = dates.local_gate(F.col("ts").cast("timestamp"), "UTC", {"morning": clock((6, 7)), "update": clock((14, 15))})
    return table(spark, d, "events").select(gate.alias("gate")).where("gate is not null").groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@C.query(r"""SELECT * FROM (SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\d{4}-\d{2}-\d{2})', 1), ''), nullif(regexp_extract(text, '((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})', 1), ''), nullif(regexp_extract(text, '(\d{1,2}/\d{1,2}/\d{4})', 1), '')) AS hint FROM documents) WHERE hint IS NOT NULL""")
def date_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select("doc_id", dates.date_hint("text").alias("hint")).where("hint is not null")


@C.query(r"""SELECT item_id, lower(trim(regexp_replace(title, '^(.*) - .*$', '\1'))) AS core FROM feed_items""")
def headline_core(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_items").select("item_id", text.headline_core("title").alias("core"))


@C.query(r"""SELECT regexp_replace(lower(regexp_extract(trim(document_url), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS domain, count(*) AS n FROM audit_documents WHERE document_url IS NOT NULL GROUP BY 1""")
def canonical_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_documents").where("document_url is not null").groupBy(urls.host("document_url").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@C.query(r"""SELECT count(*) AS n, count(*) FILTER (regexp_matches(lower(link), '[?&](utm_source|utm_medium|utm_campaign|utm_term|utm_content|gclid|fbclid|mc_cid|mc_eid)=')) AS tracked FROM feed_items WHERE link IS NOT NULL""")
def url_strip_tracking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feed_items").where("link is not null").select(F.trim("link").alias("link"))
    marks = F.lower("link").rlike("[?&](" + "|".join(urls.TRACKING) + ")=")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(marks).alias("tracked"))


@C.query(r"""WITH t AS (SELECT doc_id, content_text AS c, strpos(lower(content_text), 'set aside') AS p FROM docs)
SELECT doc_id, trim(regexp_replace(substring(c, greatest(p-180,1), p - greatest(p-180,1) + 1400), '[\s\x{00A0}]+', ' ', 'g')) AS section FROM t WHERE p > 0""")
def section_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("doc_id", text.around("content_text", "(?i)set aside", 180, 1400).alias("section")).where("section is not null")


@C.query("""SELECT event_id, strftime(max(a), '%Y-%m-%d %H:%M:%S') AS anchor FROM (SELECT event_id, ts, unnest(list_transform(range(0, 8), lambda i: date_trunc('day', ts) - i * INTERVAL 1 DAY + INTERVAL 14 HOUR)) AS a FROM events) WHERE isodow(a) IN (1, 4) AND a < ts GROUP BY event_id""")
def biweekly_anchor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", dates.latest_anchor(F.col("ts").cast("timestamp"), "UTC").alias("a"))
    return rows.select("event_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("anchor"))


_ENTITIES = "trim(regexp_replace({c}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_DECODED = "regexp_replace(text, '<[^>]*>', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&hellip;", "…"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"


@C.query(f"SELECT doc_id, {_ENTITIES.format(c=_DECODED)} AS body FROM documents WHERE contains(text, '<')")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with mark-up; the SQL decodes the entities these texts use, the query all of them."""
    rows = table(spark, d, "documents").where(F.col("text").contains("<"))
    return rows.select("doc_id", text.stripped_html("text").alias("body"))


@C.query(r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?is)<a\s[^>]*href\s*=\s*["''][^"'']+["''][^>]*>.*?</a>')) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_extract(x, '(?is)href\s*=\s*["'']([^"'']+)["'']', 1)) AS href, count(*) AS n FROM a GROUP BY ALL""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """The distinct links of each text with how often they stand there."""
    from newsloom.sources.markup import parse_documents

    return parse_documents(table(spark, d, "documents"), "doc_id", "text", "anchors").groupBy("doc_id", "href").agg(F.count(F.lit(1)).alias("n"))


@C.query(r"""WITH a AS (SELECT doc_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM (SELECT doc_id, regexp_extract_all(text, '(?is)<a\s[^>]*href\s*=\s*["''][^"'']+["''][^>]*>.*?</a>') AS xs FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS text, trim(regexp_extract(x, '(?is)href\s*=\s*["'']([^"'']+)["'']', 1)) AS href FROM a""")
def html_anchors(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.sources.markup import parse_documents

    return parse_documents(table(spark, d, "documents"), "doc_id", "text", "anchors")


QUERIES, ORACLES = C.queries, C.oracles
