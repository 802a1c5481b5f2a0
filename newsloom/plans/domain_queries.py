"""Entities, joins, dedupe, scoring, risk, failures, state and reports over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import dedupe, entities, joins, ranking, reports, scoring, similarity, state
from newsloom.plans.catalog import Catalog, rows_as
from newsloom.session import table

C = Catalog()
_KEY = r"""regexp_replace(lower(regexp_extract(trim({c}), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(trim({c}), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"""


# -- entities -------------------------------------------------------------------------------------
@C.query(rf"""WITH k AS (SELECT *, CASE WHEN length(trim(page_url)) > 0 THEN {_KEY.format(c='page_url')} END AS key FROM station_records),
b AS (SELECT key, first(station_id ORDER BY (CASE WHEN contains(lower(station_name),'friends') THEN 1 ELSE 0 END + CASE WHEN contains(lower(station_name),'inc') THEN 1 ELSE 0 END), length(station_name), lower(station_name), station_id) AS canonical_id FROM k WHERE key IS NOT NULL GROUP BY key)
SELECT station_id, coalesce(canonical_id, station_id) AS canonical_id FROM k LEFT JOIN b USING (key)""")
def canonical_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.canonical_by_address(table(spark, d, "station_records"), "station_id", "station_name", "page_url", ("friends", "inc"))


@C.query(r"""WITH n AS (SELECT station_id, trim(regexp_replace(lower(station_name), '[\s\x{00A0}]+', ' ', 'g')) AS low FROM station_records WHERE station_name IS NOT NULL),
b AS (SELECT *, trim(regexp_replace(low, ',? (inc|llc|corp)\.?$', '')) AS bare FROM n),
f AS (SELECT station_id, unnest(list_distinct(list_filter([low, bare, regexp_replace(bare, '^the ', ''), replace(bare, ' ', '-'), array_to_string(list_transform(regexp_split_to_array(regexp_replace(bare, '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: substring(w,1,1)), '')], lambda x: length(x) > 1))) AS alias FROM b)
SELECT alias, min(station_id) AS target FROM (SELECT DISTINCT alias, station_id FROM f) GROUP BY alias HAVING count(*) = 1""")
def alias_expand(spark: SparkSession, d: str) -> DataFrame:
    return entities.alias_table(table(spark, d, "station_records"), "station_id", "station_name")


@C.query(r"""WITH w AS (SELECT DISTINCT station_id, unnest(list_filter(string_split(trim(regexp_replace(replace(lower(station_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('', 'public','radio','of'))) AS token FROM station_records WHERE station_name IS NOT NULL)
SELECT token, min(station_id) AS target FROM w GROUP BY token HAVING count(*) = 1""")
def unambiguous_tokens(spark: SparkSession, d: str) -> DataFrame:
    return entities.unambiguous_tokens(table(spark, d, "station_records"), "station_id", "station_name", ("public", "radio", "of"))


@C.query("""WITH p AS (SELECT doc_id, 0 AS pos, station_name AS k FROM docs WHERE station_name IS NOT NULL UNION ALL SELECT doc_id, 1, trim(station_name) FROM docs WHERE station_name IS NOT NULL UNION ALL SELECT doc_id, 2, lower(trim(station_name)) FROM docs WHERE station_name IS NOT NULL)
SELECT doc_id, first(canonical_station_id ORDER BY pos) AS canonical_station_id FROM p JOIN station_aliases a ON p.k = a.alias AND a.canonical_station_id <> '' GROUP BY doc_id""")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").where("station_name is not null").select("doc_id", "station_name")
    keys = F.array("station_name", F.trim("station_name"), F.lower(F.trim("station_name")))
    return joins.alias_cascade(docs, "doc_id", keys, table(spark, d, "station_aliases").where("canonical_station_id <> ''"), "alias", "canonical_station_id")


@C.query("""WITH f AS (SELECT canonical_station_id AS target, min(canonical_station_name) AS name FROM station_aliases WHERE lower(alias) LIKE '%delta%' AND canonical_station_id <> '' GROUP BY 1),
s AS (SELECT canonical_station_id AS target, min(canonical_station_name) AS name FROM docs WHERE (lower(coalesce(station_name,'')) LIKE '%delta%' OR lower(coalesce(title,'')) LIKE '%delta%') AND canonical_station_id <> '' GROUP BY 1)
SELECT * FROM f UNION ALL SELECT * FROM s WHERE (SELECT count(*) FROM f) = 0""")
def station_lookup(spark: SparkSession, d: str) -> DataFrame:
    return entities.lookup_like(table(spark, d, "station_aliases").withColumnRenamed("canonical_station_name", "name_"), table(spark, d, "docs").withColumnRenamed("canonical_station_name", "name_"), "delta", "alias", "canonical_station_id", "name_", ("station_name", "title"))


@C.query(r"""SELECT count(*) AS entries, count_if(enabled) AS enabled, count_if(length(trim(coalesce(page_url,''))) > 0 AND NOT coalesce(regexp_matches(lower(trim(page_url)), '^https?://[^/\s]+'), false)) AS malformed_urls,
 count_if(enabled AND length(trim(coalesce(page_url,''))) = 0) AS enabled_without_url, count_if(NOT enabled AND length(trim(coalesce(page_url,''))) > 0) AS disabled_with_url,
 (SELECT count(*) FROM (SELECT station_id FROM station_records GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids FROM station_records""")
def station_validation(spark: SparkSession, d: str) -> DataFrame:
    return entities.validate_config(table(spark, d, "station_records"), "station_id", "page_url", F.col("enabled"))


@C.query("""SELECT CASE WHEN NOT enabled THEN 'disabled entry' WHEN length(trim(coalesce(page_url,''))) = 0 THEN 'enabled without page_url' END AS reason, count(*) AS n FROM station_records WHERE NOT enabled OR length(trim(coalesce(page_url,''))) = 0 GROUP BY 1""")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "station_records").select(entities.skip_reason(F.col("enabled"), F.col("page_url")).alias("reason"))
    return rows.where("reason is not null").groupBy("reason").agg(rows_as("n"))


@C.query("""SELECT station_id, station_name FROM station_records WHERE length(trim(coalesce(page_url,''))) = 0""")
def unresolved_stations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "station_records").where(F.length(F.trim(F.coalesce("page_url", F.lit("")))) == 0).select("station_id", "station_name")


# -- joins ----------------------------------------------------------------------------------------
_CASCADE = """SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'key' WHEN p.p IS NOT NULL THEN 'priority' WHEN s.s IS NOT NULL THEN 'status' END AS matched_by FROM orders o
 LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority LIKE '1%') p ON o.o_orderpriority = p.p
 LEFT JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F') s ON o.o_orderstatus = s.s"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    tiers = [
        ("key", "o_custkey", c.where("c_mktsegment = 'BUILDING'").select("c_custkey")),
        ("priority", "o_orderpriority", o.where("o_orderpriority like '1%'").select("o_orderpriority").distinct()),
        ("status", "o_orderstatus", o.where("o_orderstatus = 'F'").select("o_orderstatus").distinct()),
    ]
    return joins.cascade_match(o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), tiers)


@C.query(_CASCADE)
def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).select("o_orderkey", "matched_by")


@C.query(f"SELECT coalesce(matched_by, 'none') AS matched_by, count(*) AS n FROM ({_CASCADE}) GROUP BY 1")
def matched_by_hist(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).groupBy(F.coalesce("matched_by", F.lit("none")).alias("matched_by")).agg(rows_as("n"))


@C.query("""SELECT source_call_sign, count(*) AS n, min(item_id) AS first_item FROM public_files_items WHERE source_call_sign IS NOT NULL AND len(coalesce(matched_call_signs, [])) = 0 GROUP BY 1 ORDER BY n DESC, first_item LIMIT 15""")
def top_unmatched(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "public_files_items").where(F.col("source_call_sign").isNotNull() & (F.coalesce(F.size("matched_call_signs"), F.lit(0)) <= 0))
    per = rows.groupBy("source_call_sign").agg(rows_as("n"), F.min("item_id").alias("first_item"))
    return ranking.top_k(per, [F.desc("n"), F.asc("first_item")], 15)


@C.query("""WITH t AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(k), '[a-z0-9]+'), ' ') AS term FROM (SELECT unnest(matched_keywords) AS k FROM ecfs_items)), w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, string_agg(term, ',' ORDER BY term) AS terms FROM w JOIN t ON term <> '' AND contains(words, ' ' || term || ' ') GROUP BY doc_id""")
def dictionary_containment(spark: SparkSession, d: str) -> DataFrame:
    """Terms of one word or several, by an equi-join on the runs of words of their lengths."""
    terms = table(spark, d, "ecfs_items").select(F.explode("matched_keywords").alias("k")).select(text.tokens("k").alias("ws")).distinct().where(F.size("ws") > 0)
    lengths = sorted(r["n"] for r in terms.select(F.size("ws").alias("n")).distinct().collect())
    docs = table(spark, d, "documents").where("text is not null")
    return joins.token_dictionary(docs, "doc_id", text.tokens("text"), terms.select(F.array_join("ws", " ").alias("term")), "term", lengths).select("doc_id", F.array_join("terms", ",").alias("terms"))


_PH = ("fiscal year closed", "second reading", "records request", "community radio")


@C.query("SELECT doc_id, array_to_string(list_filter([%s], lambda x: x IS NOT NULL), ',') AS phrases FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(%s)($|[^a-z0-9])')" % (", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){p}($|[^a-z0-9])') THEN '{p}' END" for p in _PH), "|".join(_PH)))
def multi_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", joins.phrase_dictionary(docs, "text", _PH).alias("p")).where(F.size("p") > 0).select("doc_id", F.array_join("p", ",").alias("phrases"))


_CATS = (("money", ("deficit", "budget", "loan", "grant")), ("technical", ("antenna", "transmitter", "tower")), ("rules", ("license", "waiver", "permit")))


@C.query("SELECT item_id, array_to_string(list_filter([%s], lambda x: x IS NOT NULL), ',') AS cats FROM feed_items" % ", ".join("CASE WHEN %s THEN '%s' END" % (" OR ".join(f"contains(lower(title), '{k}')" for k in ks), n) for n, ks in _CATS))
def keyword_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_items").select("item_id", F.when(F.col("title").isNotNull(), F.array_join(scoring.categories(F.col("title"), _CATS), ",")).otherwise("").alias("cats"))


@C.query("SELECT category, count(*) AS n, min(item_id) AS first_item FROM (SELECT item_id, unnest(list_filter([%s], lambda x: x IS NOT NULL)) AS category FROM feed_items) GROUP BY category" % ", ".join("CASE WHEN %s THEN '%s' END" % (" OR ".join(f"contains(lower(title), '{k}')" for k in ks), n) for n, ks in _CATS))
def alert_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feed_items").select("item_id", F.explode(scoring.categories(F.col("title"), _CATS)).alias("category"))
    return rows.groupBy("category").agg(rows_as("n"), F.min("item_id").alias("first_item"))


@C.query(rf"""WITH p AS (SELECT id, {_KEY.format(c='url')} AS page, regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM articles),
m AS (SELECT CASE WHEN id % 3 = 0 THEN 'mirror.example' || path ELSE page END AS page, path, id * 13 % 101 AS value, id AS pos FROM p WHERE id % 5 <> 0),
e AS (SELECT page, arg_max(value, pos) AS v FROM m GROUP BY page), l AS (SELECT path, arg_max(value, pos) AS v FROM m GROUP BY path)
SELECT p.id, coalesce(e.v, l.v, 0) AS value FROM p LEFT JOIN e ON p.page = e.page LEFT JOIN l ON p.path = l.path""")
def two_tier_metrics_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "articles").select("id", urls.page_key("url").alias("page"), F.regexp_replace(urls.path("url"), "^/$", "").alias("path"))
    m = p.where("id % 5 <> 0").select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("mirror.example"), "path")).otherwise(F.col("page")).alias("page"), "path", (F.col("id") * 13 % 101).alias("value"), F.col("id").alias("pos"))
    return joins.two_tier(p, m, ("page", "path"), "value", "pos").select("id", "value")


# -- dedupe and feeds -----------------------------------------------------------------------------
@C.query("""SELECT doc_id, sha FROM (SELECT doc_id, lower(regexp_replace(trim(file_sha256), '^(?i)sha256:', '')) AS sha, row_number() OVER (PARTITION BY source_kind, lower(regexp_replace(trim(file_sha256), '^(?i)sha256:', '')) ORDER BY doc_id) AS rn FROM docs WHERE file_sha256 IS NOT NULL) WHERE rn = 1""")
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").where("file_sha256 is not null").select("doc_id", "source_kind", F.lower(F.regexp_replace(F.trim("file_sha256"), "^(?i)sha256:", "")).alias("sha"))
    return dedupe.keep_first(docs, ["source_kind", "sha"], ["doc_id"]).select("doc_id", "sha")


@C.query("""SELECT sha, count(DISTINCT source_kind) AS kinds, count(*) AS copies FROM (SELECT source_kind, lower(regexp_replace(trim(file_sha256), '^(?i)sha256:', '')) AS sha FROM docs WHERE file_sha256 IS NOT NULL) GROUP BY sha HAVING count(*) > 1""")
def cross_source_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").where("file_sha256 is not null").select("source_kind", F.lower(F.regexp_replace(F.trim("file_sha256"), "^(?i)sha256:", "")).alias("sha"))
    return docs.groupBy("sha").agg(F.countDistinct("source_kind").alias("kinds"), rows_as("copies")).where("copies > 1")


@C.query("""SELECT DISTINCT feed_title, title, published FROM feed_items""")
def row_signature_distinct(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.whole_row_distinct(table(spark, d, "feed_items").select("feed_title", "title", "published"))


_U = r"lower(regexp_extract(trim(link), '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_replace(regexp_extract(trim(link), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


@C.query(rf"""SELECT key, arg_min(title, item_id) AS title, max(fetched_at)::VARCHAR AS latest, max(length(coalesce(summary,''))) AS best_score, array_to_string(list_sort(list_filter(list_distinct(list(feed_title)), lambda x: x IS NOT NULL)), ',') AS sources, count(*) - 1 AS duplicate_count
 FROM (SELECT *, {_U} AS key FROM feed_items WHERE link IS NOT NULL AND title IS NOT NULL) GROUP BY key""".replace("max(fetched_at)::VARCHAR", "strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S')"))
def feed_dedupe_merge(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lower(F.regexp_extract(F.trim("link"), "^([A-Za-z]+://[^/?#]*)", 1)), F.regexp_replace(F.regexp_extract(F.trim("link"), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", ""))
    rows = table(spark, d, "feed_items").where("link is not null and title is not null").withColumn("key", key).withColumn("score", F.length(F.coalesce("summary", F.lit(""))).cast("long"))
    out = dedupe.merge_groups(rows, "key", "item_id", "score", "fetched_at", "feed_title", ["title"])
    return out.select("key", "title", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), "best_score", F.array_join(F.array_compact("sources"), ",").alias("sources"), "duplicate_count")


@C.query("""WITH f AS (SELECT item_id, lower(title) AS fp, feed_title LIKE 'News search%' AS weak FROM feed_items WHERE title IS NOT NULL AND feed_title IS NOT NULL)
SELECT item_id FROM f WHERE NOT weak OR fp NOT IN (SELECT fp FROM f WHERE NOT weak)""")
def aggregator_suppression(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feed_items").where("title is not null and feed_title is not null").select("item_id", F.lower("title").alias("fp"), F.col("feed_title").like("News search%").alias("weak"))
    return joins.without_shadowed(rows, "fp", F.col("weak")).select("item_id")


BOOK = scoring.Rulebook(
    (
        scoring.Rule("money", ("deficit", "layoffs", "shortfall"), 4),
        scoring.Rule("board", ("board", "trustee", "committee"), 2, per_hit=True),
        scoring.Rule("signal", ("tower", "antenna", "transmitter"), 3, unless=("playlist",)),
        scoring.Rule("routine", ("schedule", "playlist", "podcast"), -2),
    ),
    floors=((("merger",), 8),),
)
_B = lambda *ts: "regexp_matches(lower(t), '(^|[^a-z0-9])(" + "|".join(ts) + ")($|[^a-z0-9])')"
_SCORE = f"""WITH t AS (SELECT item_id, coalesce(title,'') || ' ' || coalesce(summary,'') AS t FROM feed_items),
s AS (SELECT item_id, t, CASE WHEN {_B('deficit', 'layoffs', 'shortfall')} THEN 4 ELSE 0 END
 + CASE WHEN {_B('board')} THEN 2 ELSE 0 END + CASE WHEN {_B('trustee')} THEN 2 ELSE 0 END + CASE WHEN {_B('committee')} THEN 2 ELSE 0 END
 + CASE WHEN {_B('tower', 'antenna', 'transmitter')} AND NOT {_B('playlist')} THEN 3 ELSE 0 END + CASE WHEN {_B('schedule', 'playlist', 'podcast')} THEN -2 ELSE 0 END AS base FROM t),
r AS (SELECT item_id, CAST(CASE WHEN {_B('merger')} THEN greatest(base, 8) ELSE base END AS INTEGER) AS score, array_to_string(list_filter([CASE WHEN {_B('deficit', 'layoffs', 'shortfall')} THEN 'money' END, CASE WHEN {_B('board', 'trustee', 'committee')} THEN 'board' END,
 CASE WHEN {_B('tower', 'antenna', 'transmitter')} AND NOT {_B('playlist')} THEN 'signal' END, CASE WHEN {_B('schedule', 'playlist', 'podcast')} THEN 'routine' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s)
SELECT item_id, score, reasons, CASE WHEN score >= 8 THEN 'high' WHEN score >= 5 THEN 'maybe' ELSE 'low' END AS bucket FROM r"""


def _feed_scores(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    return scoring.score(table(spark, d, "feed_items"), body, BOOK)


@C.query(_SCORE)
def feed_score(spark: SparkSession, d: str) -> DataFrame:
    return _feed_scores(spark, d).select("item_id", "score", F.array_join("reasons", ",").alias("reasons"), "bucket")


@C.query(f"SELECT bucket, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM ({_SCORE}) GROUP BY bucket")
def feed_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _feed_scores(spark, d).groupBy("bucket").agg(rows_as("n"), F.sum("score").alias("total"))


@C.query(f"SELECT item_id, score FROM ({_SCORE}) WHERE bucket <> 'low' ORDER BY score DESC, item_id LIMIT 100")
def feed_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(_feed_scores(spark, d).where("bucket <> 'low'").select("item_id", "score"), [F.desc("score"), F.asc("item_id")], 100)


@C.query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM ({_SCORE}) WHERE reasons <> '') GROUP BY reason")
def feed_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _feed_scores(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(rows_as("n"))


_SW = ("a", "an", "and", "the", "of", "for", "in", "on", "to", "what", "means")


@C.query("""WITH s AS (SELECT DISTINCT list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','the','of','for','in','on','to','what','means')))) AS s FROM feed_items WHERE title IS NOT NULL),
f AS (SELECT s FROM s WHERE len(s) >= 4), p AS (SELECT a.s AS x, b.s AS y, len(list_intersect(a.s, b.s)) AS i FROM f a JOIN f b ON a.s < b.s)
SELECT array_to_string(x, ' ') AS story_a, array_to_string(y, ' ') AS story_b, round(i / (len(x) + len(y) - i), 6) AS similarity FROM p WHERE i >= 4 AND i >= 0.8 * (len(x) + len(y) - i)""")
def story_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feed_items").where("title is not null").select(similarity.word_set("title", _SW).alias("s"))
    pairs = similarity.story_pairs(rows, "s")
    ordered = F.array_sort(F.array("set_a", "set_b"))
    return pairs.select(F.array_join(ordered[0], " ").alias("story_a"), F.array_join(ordered[1], " ").alias("story_b"), F.round("similarity", 6).alias("similarity"))


#: Milestone groups and the rule by which two titles tell one story: JON-14.
_MS = (("proposed", "proposal", "plans to", "considering"), ("filed", "files", "filing"), ("approved", "approves", "clears"), ("finalized", "finalizes", "completes", "completed", "closes", "closed"), ("blocked", "blocks", "rejects", "rejected"), ("lawsuit", "sues", "sued"), ("strike ends", "ends strike", "reaches agreement", "reached agreement"))
_RULE = {"jaccard": 0.55, "shared": 4, "many": 5, "contained": 0.85, "extra": ("ms",), "apart": ("nums",)}
_SIGNED = r"""WITH s AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','the','of','for','in','on','to','what','means')))) AS s,
list_filter([%s], lambda x: x IS NOT NULL) AS ms, list_sort(list_distinct(regexp_extract_all(lower(title), '\b\d+(?:\.\d+)?\s*(?:million|billion|percent|%%)'))) AS nums FROM feed_items WHERE title IS NOT NULL)""" % ", ".join("CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9])(%s)($|[^a-z0-9])') THEN %d END" % ("|".join(g), i) for i, g in enumerate(_MS))
_SAME = """a.ms = b.ms AND (len(a.nums) = 0 OR len(b.nums) = 0 OR a.nums = b.nums) AND len(list_intersect(a.s, b.s)) >= 4
AND (len(list_intersect(a.s, b.s)) >= 0.55 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) OR (len(list_intersect(a.s, b.s)) >= 5 AND len(list_intersect(a.s, b.s)) >= 0.85 * least(len(a.s), len(b.s))))"""


def _signed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"s": similarity.word_set("title", _SW), "ms": similarity.milestones("title", _MS), "nums": similarity.amounts("title")})


@C.query(f"""{_SIGNED}, f AS (SELECT DISTINCT s, ms, nums FROM s), d AS (SELECT *, row_number() OVER (ORDER BY s, ms, nums) AS i FROM f)
SELECT array_to_string(least(a.s, b.s), ' ') AS story_a, array_to_string(greatest(a.s, b.s), ' ') AS story_b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM d a JOIN d b ON a.i < b.i WHERE {_SAME}""")
def same_story_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The whole rule of JON-14, of which ``story_similarity_pairs`` is the part at 0.8 its SQL states."""
    pairs = similarity.story_pairs(_signed(table(spark, d, "feed_items").where("title is not null")), "s", **_RULE)
    ordered = F.array_sort(F.array("set_a", "set_b"))
    return pairs.select(F.array_join(ordered[0], " ").alias("story_a"), F.array_join(ordered[1], " ").alias("story_b"), F.round("similarity", 6).alias("similarity"))


@C.query(f"""{_SIGNED}, f AS (SELECT DISTINCT s, ms, nums FROM s WHERE len(s) >= 4), d AS (SELECT *, row_number() OVER (ORDER BY s, ms, nums) AS i FROM f),
l AS (SELECT a.i, count(*) AS n FROM d a JOIN d b ON a.i <> b.i WHERE {_SAME} GROUP BY a.i)
SELECT item_id, array_to_string(s.s, ' ') AS words, coalesce(n, 0) AS n_links FROM s JOIN d ON s.s = d.s AND s.ms = d.ms AND s.nums = d.nums LEFT JOIN l USING (i)""")
def story_links(spark: SparkSession, d: str) -> DataFrame:
    """Each item of four words or more with its class (its word set) and how many other classes tell the same story."""
    rows = _signed(table(spark, d, "feed_items").where("title is not null")).where(F.size("s") >= 4)
    pairs = similarity.story_pairs(rows, "s", **_RULE).select("ia", "ib")
    links = pairs.unionByName(pairs.select(F.col("ib").alias("ia"), F.col("ia").alias("ib"))).groupBy("ia").agg(rows_as("n_links"))
    keyed = rows.select("item_id", "s", similarity.story_id(["s", "ms", "nums"]).alias("ia"))
    return keyed.join(links, "ia", "left").select("item_id", F.array_join("s", " ").alias("words"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@C.query(f"""{_SIGNED}, o AS (SELECT DISTINCT s, ms, nums FROM s WHERE item_id % 4 = 0), n AS (SELECT * FROM s WHERE item_id % 4 <> 0)
SELECT item_id FROM n WHERE item_id NOT IN (SELECT a.item_id FROM n a JOIN o b ON {_SAME})""")
def same_story_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """The whole rule of JON-15, of which ``recent_story_antijoin`` is the part at 0.8 its SQL states."""
    rows = _signed(table(spark, d, "feed_items").where("title is not null")).select("item_id", "s", "ms", "nums")
    return similarity.unlike_recent(rows.where("item_id % 4 <> 0"), rows.where("item_id % 4 = 0"), "s", least=4, **_RULE).select("item_id")


def _stories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ranked = _signed(_feed_scores(spark, d).where("bucket <> 'low'").withColumn("title", F.coalesce("title", F.lit("")))).withColumn("maybe", (F.col("bucket") != "high").cast("int"))
    return ranked, similarity.greedy_stories(spark, ranked, "item_id", [F.col("maybe"), -F.col("score")], "s", **_RULE)


_STORIES = f"""WITH RECURSIVE f AS ({{score}}), {_SIGNED.replace("WITH s AS", "s AS").replace("WHERE title IS NOT NULL", "").replace("lower(title)", "lower(coalesce(title, ''))")},
o AS (SELECT row_number() OVER (ORDER BY bucket <> 'high', score DESC, item_id) AS i, item_id, s, ms, nums FROM f JOIN s USING (item_id) WHERE bucket <> 'low'),
n AS (SELECT b.i, list_sort(list(a.i)) AS near FROM o a JOIN o b ON a.i < b.i AND {_SAME} GROUP BY b.i),
r(i, heads, story) AS (SELECT 1::BIGINT, [1::BIGINT], 1::BIGINT UNION ALL
 SELECT i + 1, CASE WHEN head IS NULL THEN list_append(heads, i + 1) ELSE heads END, coalesce(head, i + 1) FROM (SELECT r.i, r.heads, list_filter(n.near, lambda x: list_contains(r.heads, x))[1] AS head FROM r LEFT JOIN n ON n.i = r.i + 1 WHERE r.i < (SELECT count(*) FROM o))),
t AS (SELECT a.item_id AS pos, b.item_id AS story, a.i FROM r JOIN o a ON a.i = r.i JOIN o b ON b.i = r.story)"""


@C.query(_STORIES.format(score=_SCORE) + " SELECT pos, story FROM t")
def story_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All items of the buckets high and maybe, best first, each with the item that began its story."""
    return _stories(spark, d)[1]


@C.query(_STORIES.format(score=_SCORE) + " SELECT story, arg_min(pos, (coalesce(feed_title LIKE 'News search%', false), t.i)) AS shown, count(*) AS n_items FROM t JOIN feed_items ON item_id = pos GROUP BY story")
def story_shown(spark: SparkSession, d: str) -> DataFrame:
    """The item each story is told by: an aggregator's copy gives way to the first direct one."""
    ranked, stories = _stories(spark, d)
    items = stories.join(ranked.select(F.col("item_id").alias("pos"), "maybe", "score", F.coalesce(F.col("feed_title").like("News search%"), F.lit(False)).alias("weak")), "pos")
    shown = similarity.shown_of_story(items, "story", "pos", [F.col("maybe"), -F.col("score")], F.col("weak"))
    return shown.join(stories.groupBy("story").agg(rows_as("n_items")), "story")


#: A report a day: all items of high and maybe, best first, in messages of at most 3,900 characters.
_LINES = r"""WITH RECURSIVE f AS ({score}), e AS (SELECT item_id, strftime(fetched_at, '%Y-%m-%d') AS digest, trim(regexp_replace(coalesce(title, '(no title)'), '\s+', ' ', 'g')) AS flat, coalesce(link, '') AS link, coalesce(feed_title, '') AS src FROM feed_items),
c AS (SELECT *, replace(replace(replace(replace(CASE WHEN length(flat) > 350 THEN substring(flat, 1, 349) || '…' ELSE flat END, '|', '·'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS name FROM e),
w AS (SELECT item_id, digest, '- <' || replace(replace(replace(link, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '|' || name || '> (' || src || ')' AS line, '- ' || name || ' (' || src || ')' AS spare FROM c),
l AS (SELECT digest, item_id, CASE WHEN length(line) + 10 <= {limit} THEN line ELSE spare END AS line, row_number() OVER (PARTITION BY digest ORDER BY bucket <> 'high', score DESC, item_id) AS i FROM w JOIN f USING (item_id) WHERE bucket <> 'low'),
p(digest, i, batch, size, item_id) AS (SELECT digest, i, 0::BIGINT, length(line) + 1, item_id FROM l WHERE i = 1 UNION ALL
 SELECT l.digest, l.i, CASE WHEN p.size + length(l.line) + 1 > {limit} THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.size + length(l.line) + 1 > {limit} THEN 10 + length(l.line) + 1 ELSE p.size + length(l.line) + 1 END, l.item_id FROM p JOIN l ON l.digest = p.digest AND l.i = p.i + 1),
m AS (SELECT digest, batch, count(*) AS n_lines, CASE WHEN batch > 0 THEN 'continued' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY p.i) AS text, list(p.item_id ORDER BY p.i) AS items FROM p JOIN l USING (digest, i) GROUP BY digest, batch)"""


def _digests(spark: SparkSession, d: str, limit: int) -> DataFrame:
    rows = _feed_scores(spark, d).where("bucket <> 'low'").withColumn("digest", F.date_format("fetched_at", "yyyy-MM-dd"))
    order = [(F.col("bucket") != "high").cast("int"), F.desc("score"), F.asc("item_id")]
    return reports.message_batches(rows, "digest", order, "item_id", *reports.message_lines(F.col("title"), F.col("link"), F.col("feed_title")), limit=limit)


@C.query(_LINES.format(score=_SCORE, limit=3900) + " SELECT digest, batch, n_lines, text FROM m")
def digest_batches(spark: SparkSession, d: str) -> DataFrame:
    """The messages of each day's report, over all its items."""
    return _digests(spark, d, 3_900).drop("items")


@C.query(_LINES.format(score=_SCORE, limit=300) + ", x AS (SELECT digest, min(batch) AS b FROM m WHERE batch >= 1 AND CAST(substring(digest, 10, 1) AS INTEGER) % 2 = 0 GROUP BY digest) SELECT m.digest, unnest(items) AS id FROM m LEFT JOIN x USING (digest) WHERE b IS NULL OR batch < b")
def delivery_partial(spark: SparkSession, d: str) -> DataFrame:
    """Items delivered where, on days that end in an even digit, all messages after the first fail."""
    messages = _digests(spark, d, 300)
    failed = messages.where("batch >= 1 and cast(substring(digest, 10, 1) as int) % 2 = 0").select("digest", "batch")
    return state.delivered_items(messages, ["digest"], "batch", "items", failed)


@C.query(_LINES.format(score=_SCORE, limit=300) + ", x AS (SELECT DISTINCT digest FROM m WHERE batch >= 1 AND CAST(substring(digest, 10, 1) AS INTEGER) % 2 = 0) SELECT DISTINCT m.digest, CASE WHEN x.digest IS NULL THEN m.digest ELSE '2020-01-01' END AS last_checked FROM m LEFT JOIN x USING (digest)")
def delivery_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """A report's check time, which stays where it was if one of its messages failed."""
    messages = _digests(spark, d, 300)
    failed = messages.where("batch >= 1 and cast(substring(digest, 10, 1) as int) % 2 = 0").select("digest")
    return state.next_check(messages.select("digest").distinct(), failed, ["digest"], F.lit("2020-01-01"), F.col("digest"))


@C.query("""WITH m AS (SELECT title, max(fetched_at) AS sent FROM feed_items WHERE title IS NOT NULL AND item_id % 3 <> 0 AND fetched_at >= TIMESTAMP '2024-06-01' - INTERVAL 72 HOUR GROUP BY title), n AS (SELECT DISTINCT title, TIMESTAMP '2024-06-01' AS sent FROM feed_items WHERE title IS NOT NULL AND item_id % 3 = 0)
SELECT title, strftime(max(sent), '%Y-%m-%d %H:%M:%S') AS sent FROM (SELECT * FROM m UNION ALL SELECT * FROM n) GROUP BY title""")
def story_memory(spark: SparkSession, d: str) -> DataFrame:
    """The titles remembered after a run: those of the last 72 hours and those delivered now."""
    rows = table(spark, d, "feed_items").where("title is not null").select("item_id", "title", F.col("fetched_at").cast("timestamp").alias("sent"))
    out = state.title_memory(rows.where("item_id % 3 <> 0"), rows.where("item_id % 3 = 0"), F.lit("2024-06-01").cast("timestamp"))
    return out.select("title", F.date_format("sent", "yyyy-MM-dd HH:mm:ss").alias("sent"))


#: Steps in their order: what comes after a floor still lowers it, a cap is the last word.
ORDERED = scoring.Rulebook(
    (
        scoring.Rule("money", ("deficit", "layoffs", "shortfall"), 4),
        scoring.Rule("board", ("board", "trustee", "committee"), 2, per_hit=True),
        scoring.Rule("dispute", ("petition", "complaint"), 3, needs=(("license", "tower", "antenna"),), unless=("dismissed",)),
        scoring.Rule("rise", (), 2, pattern=r"rose to \$[0-9,.]+ million"),
        scoring.Rule("merger", ("merger",), 8, kind="floor", unless=("proposed",)),
        scoring.Rule("routine", ("schedule", "playlist", "podcast"), -3),
        scoring.Rule("aggregator", (), 4, kind="cap", where=lambda: F.col("feed_title").like("News search%")),
    )
)
_STEPS = rf"""WITH t AS (SELECT item_id, coalesce(feed_title LIKE 'News search%', false) AS agg, coalesce(title,'') || ' ' || coalesce(summary,'') AS t FROM feed_items),
h AS (SELECT item_id, agg, {_B('deficit', 'layoffs', 'shortfall')} AS h1, CAST({_B('board')} AS INTEGER) + CAST({_B('trustee')} AS INTEGER) + CAST({_B('committee')} AS INTEGER) AS n2, {_B('petition', 'complaint')} AND {_B('license', 'tower', 'antenna')} AND NOT {_B('dismissed')} AS h3,
 regexp_matches(lower(t), 'rose to \$[0-9,.]+ million') AS h4, {_B('merger')} AND NOT {_B('proposed')} AS h5, {_B('schedule', 'playlist', 'podcast')} AS h6 FROM t),
a AS (SELECT *, CASE WHEN h1 THEN 4 ELSE 0 END + 2 * n2 + CASE WHEN h3 THEN 3 ELSE 0 END + CASE WHEN h4 THEN 2 ELSE 0 END AS s1 FROM h),
b AS (SELECT *, CASE WHEN h5 THEN greatest(s1, 8) ELSE s1 END - CASE WHEN h6 THEN 3 ELSE 0 END AS s2 FROM a),
c AS (SELECT *, CASE WHEN agg THEN least(s2, 4) ELSE s2 END AS s FROM b)
SELECT item_id, CAST(s AS INTEGER) AS score, array_to_string(list_filter([CASE WHEN h1 THEN 'money' END, CASE WHEN n2 > 0 THEN 'board' END, CASE WHEN h3 THEN 'dispute' END, CASE WHEN h4 THEN 'rise' END, CASE WHEN h5 THEN 'merger' END, CASE WHEN h6 THEN 'routine' END, CASE WHEN agg THEN 'aggregator' END], lambda x: x IS NOT NULL), ',') AS reasons,
 CASE WHEN s >= 8 THEN 'high' WHEN s >= 5 THEN 'maybe' ELSE 'low' END AS bucket FROM c"""


@C.query(_STEPS)
def feed_score_steps(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    return scoring.score(table(spark, d, "feed_items"), body, ORDERED).select("item_id", "score", F.array_join("reasons", ",").alias("reasons"), "bucket")


_MODES = {"balanced": ("merger", "license", "tower", "renewal"), "high": ("merger", "license")}


@C.query(" UNION ALL ".join("SELECT '%s' AS mode, item_id FROM public_files_items WHERE coalesce(%s, false) OR (len(coalesce(matched_call_signs, [])) > 0 AND len(list_filter(coalesce(matched_keywords, []), lambda k: lower(k) NOT IN ('translator', 'license'))) > 0)" % (m, " OR ".join(f"contains(lower(title), '{x}')" for x in xs)) for m, xs in _MODES.items()))
def editorial_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Both modes of the predicate: a section in the title, or a call sign with a keyword that isn't weak."""
    rows = table(spark, d, "public_files_items")
    out = [rows.where(scoring.relevant(F.col("title"), xs, F.col("matched_call_signs"), F.col("matched_keywords"), ("translator", "license"))).select(F.lit(m).alias("mode"), "item_id") for m, xs in _MODES.items()]
    return out[0].unionByName(out[1])


@C.query("""WITH j AS (SELECT item_id, lower(coalesce(title,'')) AS t, regexp_replace(lower(regexp_extract(trim(link), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM feed_items WHERE link IS NOT NULL)
SELECT item_id FROM j WHERE NOT regexp_matches(t, '(jobs? at|help wanted|position available|vacancy)\\s*:') AND host NOT IN ('jobs.example', 'boards.example') AND NOT contains(t, 'hires')""")
def job_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.coalesce("title", F.lit("")))
    rows = table(spark, d, "feed_items").where("link is not null")
    return rows.where(~t.rlike(r"(jobs? at|help wanted|position available|vacancy)\s*:") & ~urls.host("link").isin("jobs.example", "boards.example") & ~t.contains("hires")).select("item_id")


# -- dockets, public files ------------------------------------------------------------------------
@C.query("""SELECT filing_id FROM ecfs_items WHERE len(coalesce(matched_call_signs, [])) > 0 OR len(coalesce(matched_keywords, [])) > 0""")
def docket_filter(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return table(spark, d, "ecfs_items").where(has("matched_call_signs") | has("matched_keywords")).select("filing_id")


@C.query("""SELECT min(filing_id) AS filing_id, trim(link) AS link, count(*) AS copies FROM ecfs_items WHERE link IS NOT NULL GROUP BY trim(link)""")
def docket_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ecfs_items").where("link is not null").groupBy(F.trim("link").alias("link")).agg(F.min("filing_id").alias("filing_id"), rows_as("copies"))


@C.query("""SELECT item_id FROM public_files_items WHERE (contains(lower(title), 'transmitter') OR contains(lower(title), 'license') OR contains(lower(title), 'tower')) AND NOT contains(lower(title), 'draft')""")
def public_file_relevance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "public_files_items").where(scoring.included(F.col("title"), ("transmitter", "license", "tower"), ("draft",))).select("item_id")


@C.query("""SELECT DISTINCT 'public_files:' || coalesce(source_call_sign, '') || ':' || coalesce(nullif(trim(document_link), ''), trim(link), CAST(item_id AS VARCHAR)) AS key FROM public_files_items""")
def alert_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("public_files:"), F.coalesce("source_call_sign", F.lit("")), F.lit(":"), F.coalesce(F.nullif(F.trim("document_link"), F.lit("")), F.trim("link"), F.col("item_id").cast("string")))
    return table(spark, d, "public_files_items").select(key.alias("key")).distinct()


# -- audit documents ------------------------------------------------------------------------------
_KINDS = (("audited_financial", ("single audit", "audited")), ("financial_statement", ("financial statement",)), ("annual_report", ("annual report", "community report")))
_KIND = "CASE WHEN contains(lower(title),'single audit') OR contains(lower(title),'audited') THEN 'audited_financial' WHEN contains(lower(title),'financial statement') THEN 'financial_statement' WHEN contains(lower(title),'annual report') OR contains(lower(title),'community report') THEN 'annual_report' ELSE 'other' END"


@C.query(f"SELECT kind, file_ext, count(*) AS n FROM (SELECT {_KIND} AS kind, file_ext FROM audit_documents) GROUP BY kind, file_ext")
def doc_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audit_documents").select(scoring.ordered_label(F.col("title"), _KINDS, "other").alias("kind"), "file_ext")
    return rows.groupBy("kind", "file_ext").agg(rows_as("n"))


@C.query(f"""WITH k AS (SELECT record_no, station_id, CASE {_KIND} WHEN 'audited_financial' THEN 0 WHEN 'financial_statement' THEN 1 WHEN 'annual_report' THEN 2 ELSE 3 END AS kr, coalesce(try_cast(regexp_extract(title, '(20[0-9][0-9])', 1) AS INTEGER), 0) AS y FROM audit_documents)
SELECT record_no, station_id FROM (SELECT *, rank() OVER (PARTITION BY station_id ORDER BY kr, y DESC) AS rk FROM k) WHERE rk = 1""")
def latest_per_station(spark: SparkSession, d: str) -> DataFrame:
    kind = scoring.ordered_label(F.col("title"), _KINDS, "other")
    rank = F.when(kind == "audited_financial", 0).when(kind == "financial_statement", 1).when(kind == "annual_report", 2).otherwise(3)
    year = F.coalesce(F.regexp_extract("title", "(20[0-9][0-9])", 1).try_cast("int"), F.lit(0))
    rows = table(spark, d, "audit_documents").select("record_no", "station_id", rank.alias("kr"), year.alias("y"))
    return ranking.best_with_ties(rows, ["station_id"], [F.col("kr"), -F.col("y")]).select("record_no", "station_id")


@C.query("""SELECT record_no FROM audit_documents WHERE file_ext IN ('.pdf','.doc','.docx','.xls','.xlsx') AND regexp_matches(lower(coalesce(title,'') || ' ' || coalesce(document_url,'')), 'audit|financial') AND NOT contains(lower(coalesce(title,'')), 'eeo')""")
def candidate_documents(spark: SparkSession, d: str) -> DataFrame:
    blob = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("document_url", F.lit(""))))
    rows = table(spark, d, "audit_documents").where(F.col("file_ext").isin(".pdf", ".doc", ".docx", ".xls", ".xlsx"))
    return rows.where(blob.rlike("audit|financial") & ~F.lower(F.coalesce("title", F.lit(""))).contains("eeo")).select("record_no")


@C.query("""SELECT record_no FROM (SELECT record_no, row_number() OVER (PARTITION BY station_id, coalesce(nullif(trim(document_url),''), downloaded_path), year(discovered_date) ORDER BY discovered_date, record_no) AS rn FROM audit_documents WHERE discovered_date >= DATE '2024-03-01') WHERE rn = 1""")
def recent_docs_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audit_documents").where("discovered_date >= date '2024-03-01'").select("record_no", "station_id", "discovered_date", F.coalesce(F.nullif(F.trim("document_url"), F.lit("")), "downloaded_path").alias("u"), F.year("discovered_date").alias("y"))
    return dedupe.keep_first(rows, ["station_id", "u", "y"], ["discovered_date", "record_no"]).select("record_no")


PATTERNS = (
    scoring.RiskPattern("reserve", "reserve fell below"),
    scoring.RiskPattern("lapsed", "agreement had lapsed"),
    scoring.RiskPattern("deficit", "deficit", soft=True),
    scoring.RiskPattern("incomplete", "estimate was incomplete", soft=True),
)
_HITS = """WITH h AS (SELECT coalesce(nullif(canonical_station_id, ''), station_id) AS g, doc_id, title, lower(content_text) AS c, pos, label, soft, strpos(lower(content_text), pat) AS p FROM docs,
 (VALUES (0,'reserve','reserve fell below',false),(1,'lapsed','agreement had lapsed',false),(2,'deficit','deficit',true),(3,'incomplete','estimate was incomplete',true)) v(pos,label,pat,soft) WHERE content_text IS NOT NULL),
x AS (SELECT *, substring(c, greatest(p-320,1), p - greatest(p-320,1) + 420) AS ctx FROM h WHERE p > 0),
y AS (SELECT g, doc_id, title, label, pos, CASE WHEN contains(ctx, 'routine') OR (soft AND NOT contains(ctx, 'layoffs') AND NOT contains(ctx, 'emergency')) THEN 'watchlist' ELSE 'higher' END AS tier FROM x),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, title, label ORDER BY doc_id) AS rn FROM y) WHERE rn = 1),
e AS (SELECT g, doc_id, min(CASE WHEN {stop} THEN pos END) AS stop FROM f GROUP BY g, doc_id),
r AS (SELECT f.g AS canonical_station_id, f.doc_id, f.title, f.label, f.tier, f.pos FROM f JOIN e ON f.g IS NOT DISTINCT FROM e.g AND f.doc_id = e.doc_id WHERE e.stop IS NULL OR f.pos <= e.stop)"""


def _station() -> Column:
    """The station a document counts under: its own, or while that is unresolved its folder's."""
    return F.coalesce(F.nullif("canonical_station_id", F.lit("")), "station_id")


def _risks(spark: SparkSession, d: str, mode: str, strict: bool = False) -> DataFrame:
    docs = table(spark, d, "docs").where("content_text is not null").select(_station().alias("canonical_station_id"), "doc_id", "title", "content_text")
    return scoring.risk_scan(docs, "canonical_station_id", ["doc_id"], "title", "content_text", PATTERNS, ("routine",), ("layoffs", "emergency"), mode, strict)


@C.query(_HITS.format(stop="tier = 'higher'") + " SELECT canonical_station_id, doc_id, label, tier FROM r")
def risk_scan_continue(spark: SparkSession, d: str) -> DataFrame:
    return _risks(spark, d, "continue").select("canonical_station_id", "doc_id", "label", "tier")


@C.query(_HITS.format(stop="true") + " SELECT canonical_station_id, doc_id, label, tier FROM r")
def risk_scan_break(spark: SparkSession, d: str) -> DataFrame:
    return _risks(spark, d, "break").select("canonical_station_id", "doc_id", "label", "tier")


@C.query(_HITS.format(stop="tier = 'higher'").replace("WHERE content_text IS NOT NULL", "WHERE NOT soft AND content_text IS NOT NULL") + " SELECT canonical_station_id, doc_id, label, tier FROM r")
def risk_strict(spark: SparkSession, d: str) -> DataFrame:
    return _risks(spark, d, "continue", strict=True).select("canonical_station_id", "doc_id", "label", "tier")


@C.query(_HITS.format(stop="true") + """ SELECT canonical_station_id, first(tier ORDER BY tier <> 'higher', doc_id, pos) AS tier, first(label ORDER BY tier <> 'higher', doc_id, pos) AS label, count_if(tier = 'higher') AS higher_hits, count_if(tier = 'watchlist') AS watchlist_hits FROM r GROUP BY canonical_station_id""")
def risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scoring.risk_rollup(_risks(spark, d, "break"), "canonical_station_id", ["doc_id"]).drop("title")


#: Twelve ordered patterns, some with what makes a hit boilerplate or worse.
TWELVE = (
    scoring.RiskPattern("reserve", "reserve fell below"), scoring.RiskPattern("lapsed", "agreement had lapsed", lead=("neither",)), scoring.RiskPattern("objection", "several members objected", needs=("public radio", "public media", "television")),
    scoring.RiskPattern("negotiation", "negotiations continued", stock=("routine",)), scoring.RiskPattern("records", "following a records request"), scoring.RiskPattern("layoffs", "layoffs"), scoring.RiskPattern("suspended", "was suspended late"),
    scoring.RiskPattern("deficit", "deficit", soft=True, stress=("emergency", "legal")), scoring.RiskPattern("debt", "mortgage", soft=True, stress=("overdue", "contested")), scoring.RiskPattern("loan", "refinancing", soft=True, stress=("delayed",)),
    scoring.RiskPattern("incomplete", "estimate was incomplete", soft=True), scoring.RiskPattern("unaudited", "unaudited", soft=True, stock=("interim",), stress=("restated",)),
)
_any = lambda where, xs: "(" + (" OR ".join(f"contains({where}, '{x}')" for x in xs) or "false") + ")"
_PLAIN = r"trim(regexp_replace(translate({c}, '’‘“”', chr(39) || chr(39) || chr(34) || chr(34)), '\s+', ' ', 'g'))"
_TWELVE = f"""WITH h AS (SELECT coalesce(nullif(canonical_station_id, ''), station_id) AS g, doc_id, title, lower(content_text) AS c, pos, label, soft, strpos(lower(content_text), pat) AS p FROM docs,
 (VALUES {", ".join(f"({i},'{p.label}','{p.pattern}',{str(p.soft).lower()})" for i, p in enumerate(TWELVE))}) v(pos,label,pat,soft) WHERE content_text IS NOT NULL),
x AS (SELECT *, {_PLAIN.format(c="substring(c, greatest(p-320,1), p - greatest(p-320,1) + 420)")} AS ctx, {_PLAIN.format(c="substring(c, greatest(p-160,1), p - greatest(p-160,1))")} AS lead FROM h WHERE p > 0),
y AS (SELECT g, doc_id, title, label, pos, CASE WHEN CASE pos {" ".join(f"WHEN {i} THEN {_any('ctx', p.stock)} OR {_any('lead', p.lead)} OR {'NOT ' + _any('ctx', p.needs) if p.needs else 'false'}" for i, p in enumerate(TWELVE))} END
 OR (soft AND NOT CASE pos {" ".join(f"WHEN {i} THEN {_any('ctx', p.stress)}" for i, p in enumerate(TWELVE))} END) THEN 'watchlist' ELSE 'higher' END AS tier FROM x),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, title, label ORDER BY doc_id) AS rn FROM y) WHERE rn = 1),
e AS (SELECT g, doc_id, min(CASE WHEN tier = 'higher' THEN pos END) AS stop FROM f GROUP BY g, doc_id)
SELECT f.g AS station, f.doc_id, f.label, f.tier FROM f JOIN e ON f.g IS NOT DISTINCT FROM e.g AND f.doc_id = e.doc_id WHERE e.stop IS NULL OR f.pos <= e.stop"""


@C.query(_TWELVE)
def risk_scan_all(spark: SparkSession, d: str) -> DataFrame:
    """Twelve patterns over every document; one whose station is unresolved counts under its folder's."""
    docs = table(spark, d, "docs").where("content_text is not null").select(_station().alias("station"), "doc_id", "title", "content_text")
    return scoring.risk_scan(docs, "station", ["doc_id"], "title", "content_text", TWELVE).select("station", "doc_id", "label", "tier")


@C.query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(regexp_replace(lower(content_text), 'no deficit[^.]*\.', ' ', 'g'), 'deficit') THEN 'Deficit noted' END, CASE WHEN regexp_matches(lower(content_text), 'several members objected') THEN 'Objections noted' END], lambda x: x IS NOT NULL), ',') AS flags FROM docs WHERE content_text IS NOT NULL""")
def audit_flags_scrubbed(spark: SparkSession, d: str) -> DataFrame:
    flags = (("Deficit noted", "deficit", (r"no deficit[^.]*\.",)), ("Objections noted", "several members objected", ()))
    return table(spark, d, "docs").where("content_text is not null").select("doc_id", F.array_join(scoring.scrubbed_flags(F.col("content_text"), flags), ",").alias("flags"))


_QW = ("antenna", "deficit", "renewal")
_QS = "(" + " + ".join(f"CASE WHEN contains(lower(content_text), '{w}') THEN 4 ELSE 0 END" for w in _QW) + " + CASE WHEN contains(lower(content_text), 'percent') THEN 2 ELSE 0 END - CASE WHEN contains(lower(content_text), 'confidential draft') THEN 6 ELSE 0 END)"


@C.query(f"""WITH s AS (SELECT doc_id, report_year, CAST({_QS} AS INTEGER) AS score FROM docs WHERE content_text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY report_year ORDER BY score DESC, doc_id) AS rn FROM s)
SELECT doc_id, report_year, score FROM r WHERE rn <= 2 ORDER BY score DESC, doc_id LIMIT 12""")
def question_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docs").where("content_text is not null").select("doc_id", "report_year", scoring.question_score(F.col("content_text"), _QW, ("percent",), ("confidential draft",)).alias("score"))
    return ranking.capped_ranking(rows, "report_year", [F.desc("score"), F.asc("doc_id")], 2, 12)


@C.query(rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(content_text), '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ss FROM docs WHERE content_text IS NOT NULL),
s AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS t FROM p),
h AS (SELECT *, {" + ".join(f"CAST(contains(lower(t), '{w}') AS INTEGER)" for w in _QW)} - 2 * CAST(contains(lower(t), 'routine') AS INTEGER) AS hits FROM s WHERE length(t) >= 25),
b AS (SELECT doc_id, arg_min(t, (-hits, i)) AS t, max(hits) AS hits FROM h GROUP BY doc_id) SELECT doc_id, substring(t, 1, 320) AS sentence, hits FROM b WHERE hits > 0""")
def best_sentence(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_sentences(table(spark, d, "docs").where("content_text is not null"), "doc_id", "content_text", _QW, ("routine",))


@C.query("""SELECT coalesce(nullif(canonical_station_id, ''), station_id) AS station, array_to_string(list_sort(list(DISTINCT report_year)), ',') AS years FROM docs WHERE report_year > 0 GROUP BY 1""")
def year_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docs").where("report_year > 0")
    return rows.groupBy(_station().alias("station")).agg(F.array_join(F.array_sort(F.collect_set("report_year")), ",").alias("years"))


@C.query("""SELECT coalesce(nullif(canonical_station_id, ''), station_id) AS station, report_year, count(*) AS n, round(max(file_mtime), 3) AS newest, arg_min(doc_id, (file_mtime, doc_id)) AS first_doc FROM docs WHERE file_mtime IS NOT NULL GROUP BY 1, 2""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docs").where("file_mtime is not null")
    return rows.groupBy(_station().alias("station"), "report_year").agg(rows_as("n"), F.round(F.max("file_mtime"), 3).alias("newest"), F.min_by("doc_id", F.struct("file_mtime", "doc_id")).alias("first_doc"))


@C.query("""WITH l AS (SELECT coalesce(nullif(canonical_station_id, ''), station_id) AS s, title, doc_id, row_number() OVER (PARTITION BY coalesce(nullif(canonical_station_id, ''), station_id) ORDER BY doc_id) AS i FROM docs)
SELECT s AS station, string_agg('[S' || i || '] ' || coalesce(title, ''), chr(10) ORDER BY i) AS context FROM l WHERE i <= 5 GROUP BY s""")
def context_builder(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docs").withColumn("station", _station())
    return reports.context_lines(rows, "station", ["doc_id"], F.coalesce("title", F.lit("")), 5)


@C.query("""SELECT doc_id FROM docs WHERE contains(file_path, '/semipublic/')""")
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where(F.col("file_path").contains("/semipublic/")).select("doc_id")


@C.query("""SELECT page_url, CAST(CASE WHEN contains(u, 'donate') THEN -100 ELSE (CASE WHEN contains(u,'audit') THEN 2 ELSE 0 END + CASE WHEN contains(u,'financial') THEN 2 ELSE 0 END + CASE WHEN len(string_split(regexp_replace(page_url,'^[a-z]+://',''),'/')) > 2 THEN 1 ELSE 0 END + CASE WHEN starts_with(lower(page_url),'https://') THEN 1 ELSE 0 END) END AS INTEGER) AS score FROM (SELECT DISTINCT page_url, lower(page_url) AS u FROM audit_documents WHERE page_url IS NOT NULL)""")
def page_candidate_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "audit_documents").where("page_url is not null").select("page_url").distinct()
    return rows.select("page_url", scoring.page_score(F.col("page_url"), F.lit(""), ("audit", "financial"), (("donate", -100),)).alias("score"))


@C.query(_HITS.format(stop="tier = 'higher'") + " SELECT canonical_station_id, label, min(doc_id) AS doc_id FROM r WHERE tier = 'watchlist' GROUP BY canonical_station_id, label")
def risk_watchlist(spark: SparkSession, d: str) -> DataFrame:
    hits = _risks(spark, d, "continue").where("tier = 'watchlist'")
    return dedupe.keep_first(hits, ["canonical_station_id", "label"], ["doc_id"]).select("canonical_station_id", "label", "doc_id")


@C.query("""WITH s AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','the','of','for','in','on','to','what','means')))) AS s FROM feed_items WHERE title IS NOT NULL),
o AS (SELECT DISTINCT s FROM s WHERE item_id % 4 = 0), n AS (SELECT * FROM s WHERE item_id % 4 <> 0),
x AS (SELECT DISTINCT n.item_id FROM n JOIN o ON n.s = o.s OR (len(list_intersect(n.s, o.s)) >= 4 AND len(list_intersect(n.s, o.s)) >= 0.8 * (len(n.s) + len(o.s) - len(list_intersect(n.s, o.s)))))
SELECT item_id FROM n WHERE item_id NOT IN (SELECT item_id FROM x)""")
def recent_story_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feed_items").where("title is not null").select("item_id", similarity.word_set("title", _SW).alias("s"))
    return similarity.unlike_recent(rows.where("item_id % 4 <> 0"), rows.where("item_id % 4 = 0"), "s").select("item_id")


@C.query("""SELECT id, value FROM (SELECT id, id * 13 % 101 AS value, fetched_at FROM articles) ORDER BY value DESC, fetched_at DESC NULLS LAST, id LIMIT 50""")
def post_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("id", (F.col("id") * 13 % 101).alias("value"), "fetched_at")
    return ranking.top_k(rows, [F.desc("value"), F.desc_nulls_last("fetched_at"), F.asc("id")], 50).select("id", "value")


@C.query(f"""SELECT item_id, CAST(CASE WHEN feed_title LIKE 'News search%' THEN least(score, 4) ELSE score END AS INTEGER) AS score FROM ({_SCORE}) JOIN feed_items USING (item_id)""")
def social_adjust(spark: SparkSession, d: str) -> DataFrame:
    capped = F.when(F.col("feed_title").like("News search%"), F.least(F.col("score"), F.lit(4))).otherwise(F.col("score"))
    return _feed_scores(spark, d).select("item_id", capped.alias("score"))


QUERIES, ORACLES = C.queries, C.oracles
