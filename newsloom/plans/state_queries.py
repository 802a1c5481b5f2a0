"""State between runs, event windows, streams, report tables and relational reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import joins, ranking, reports, scoring, state
from newsloom.plans.catalog import Catalog, rows_as
from newsloom.session import shared_dir, table
from newsloom.sources import markup
from newsloom.streaming import pipelines

C = Catalog()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# -- state ----------------------------------------------------------------------------------------
@C.query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def seen_antijoin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return state.unseen(e, e.where("event_type = 'purchase'").select("event_id"), "event_id").select("event_id", "user_id")


@C.query("SELECT user_id, seq FROM (SELECT user_id, max(event_id) AS seq FROM events GROUP BY user_id) ORDER BY seq DESC, user_id LIMIT 100")
def seen_prune(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"))
    return state.remember(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), "user_id", "seq", 100)


@C.query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 72 HOUR")
def overlap_window(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return state.overlap_window(_events(spark, d), "ts", now - F.make_interval(hours=F.lit(2)), now, 72).select("event_id")


@C.query("""WITH o AS (SELECT user_id, max((ts, event_id)) AS ok FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT e.user_id, count_if(ok IS NULL OR (ts, event_id) > ok) AS streak FROM events e LEFT JOIN o USING (user_id) GROUP BY e.user_id""")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return state.failure_streaks(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@C.query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f AS (SELECT user_id, rn, rn - row_number() OVER (PARTITION BY user_id ORDER BY rn) AS g FROM n WHERE event_type = 'error')
SELECT user_id, CAST(min(rn) AS INTEGER) AS first_run, CAST(max(rn) AS INTEGER) AS last_run, count(*) AS n FROM f GROUP BY user_id, g""")
def failure_islands(spark: SparkSession, d: str) -> DataFrame:
    return state.islands(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@C.query("""SELECT user_id, strftime(unnest(generate_series(greatest(last_day + 1, DATE '2024-01-31' - 13), DATE '2024-01-31', INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM (SELECT user_id, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY user_id)""")
def catchup_dates(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("date").alias("last_day"))
    days = last.select("user_id", F.explode(state.catch_up_days(F.col("last_day"), F.lit("2024-01-31").cast("date"))).alias("day"))
    return days.select("user_id", F.col("day").cast("string").alias("day"))


@C.query("SELECT strftime(ts, '%Y-%m') AS month, user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def monthly_views(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'view'")
    return rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").agg(rows_as("views"))


# -- failures -------------------------------------------------------------------------------------
#: Error texts as clients report them, and the types they are told apart by, the first that fits.
_TEXTS = (
    "HTTP Error 404: Not Found", "HTTP Error 403: Forbidden", "SSL: CERTIFICATE_VERIFY_FAILED unable to get local issuer", "download/archive failed: disk full", "The read operation timed out", "_ssl.c:983: The handshake operation timed out",
    "[Errno 54] Connection reset by peer", "Remote end closed connection without response", "[Errno 8] nodename nor servname provided, or not known", "HTTP Error 503: Service Unavailable", "Name or service not known", "HTTP Error 404 after download/archive failed, timeout",
)
_ERRORS = (
    ("http_404", ("http error 404",)), ("ssl_certificate", ("certificate_verify_failed",)), ("archive", ("download/archive failed",)), ("timeout", ("timed out", "timeout")), ("connection_reset", ("connection reset", "errno 54")),
    ("connection_closed", ("remote end closed connection",)), ("dns", ("nodename nor servname", "name or service not known")), ("http_5xx", ("http error 5",)),
)
_TRANSIENT = ("timeout", "connection_reset", "connection_closed", "dns", "http_5xx", "other")
_SPARK_ERROR = "element_at(array(%s), cast(event_id %% %d as int) + 1)" % (", ".join(f"'{t}'" for t in _TEXTS), len(_TEXTS))
_DUCK_ERROR = "([%s])[CAST(event_id %% %d AS INTEGER) + 1]" % (", ".join(f"'{t}'" for t in _TEXTS), len(_TEXTS))
_KIND = "CASE " + " ".join("WHEN %s THEN '%s'" % (" OR ".join(f"contains(lower(error), '{x}')" for x in xs), n) for n, xs in _ERRORS) + " ELSE 'other' END"
_TYPED = f"SELECT *, {_KIND} AS kind FROM (SELECT event_id, user_id, ts, {_DUCK_ERROR} AS error FROM events WHERE event_type = 'error')"


def _failures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.expr(_SPARK_ERROR).alias("error"))
    return rows.withColumn("kind", scoring.ordered_label(F.col("error"), _ERRORS, "other"))


@C.query(f"SELECT kind, count(*) AS n FROM ({_TYPED}) GROUP BY kind")
def failure_types(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d).groupBy("kind").agg(rows_as("n"))


@C.query(f"""WITH k AS (SELECT user_id, kind, count(*) AS n FROM ({_TYPED}) GROUP BY 1, 2)
SELECT k.user_id, CAST(sum(n) AS BIGINT) AS failures, string_agg(kind || '=' || n, ',' ORDER BY kind) AS types, any_value(l.e) AS last_error FROM k JOIN (SELECT user_id, arg_max(error, event_id) AS e FROM ({_TYPED}) GROUP BY 1) l USING (user_id) GROUP BY k.user_id""")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    out = reports.failure_summary(_failures(spark, d).withColumn("url", F.lit("")), "user_id", "kind", "event_id", "error", "url")
    types = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("user_id", "failures", types.alias("types"), "last_error")


@C.query(f"SELECT DISTINCT user_id FROM ({_TYPED}) WHERE kind IN {_TRANSIENT}")
def transient_retry_set(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return joins.retry_set(_failures(spark, d), users, "user_id", F.col("kind").isin(*_TRANSIENT))


@C.query(f"WITH f AS ({_TYPED}) SELECT event_id, kind FROM f WHERE user_id NOT IN (SELECT user_id FROM f WHERE kind = 'connection_reset') UNION ALL SELECT event_id, 'retried' FROM f WHERE kind = 'connection_reset'")
def failure_replacement(spark: SparkSession, d: str) -> DataFrame:
    f = _failures(spark, d).select("event_id", "user_id", "kind")
    fresh = f.where("kind = 'connection_reset'").withColumn("kind", F.lit("retried"))
    return joins.replace_failures(f, fresh.select("user_id"), fresh, "user_id").select("event_id", "kind")


# -- rankings over the star schema ----------------------------------------------------------------
@C.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def ranked_page(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 10)


@C.query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2""")
def top_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_k_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@C.query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderpriority, CAST(rn = 1 AS INTEGER) AS is_first FROM r ORDER BY is_first DESC, o_totalprice DESC, o_orderkey LIMIT 12""")
def firsts_ahead(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.firsts_ahead(rows, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 12).select("o_orderkey", "o_orderpriority", "is_first")


@C.query("""SELECT l_orderkey, l_linenumber, CASE WHEN flag THEN CAST(coalesce(sum(CAST(flag AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS BIGINT) END AS side FROM (SELECT *, l_returnflag = 'R' AS flag FROM lineitem)""")
def square_layout_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return ranking.alternating_index(rows, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey")], F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "side")


@C.query("""SELECT y, round(v, 4) AS total, round((v - lag(v) OVER (ORDER BY y)) / lag(v) OVER (ORDER BY y), 6) AS change FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1)""")
def ratios_yoy(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    per = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    before = F.lag("v").over(W.orderBy("y"))  # one row a year
    return per.select("y", F.round("v", 4).alias("total"), F.round((F.col("v") - before) / before, 6).alias("change"))


@C.query("""SELECT n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    joined = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(rows_as("n_orders"), F.round(F.sum("rev"), 2).alias("revenue"))


@C.query("""SELECT string_agg(reason || '=' || n, ';' ORDER BY reason) AS counts FROM (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1)""")
def counts_by_reason(spark: SparkSession, d: str) -> DataFrame:
    out = reports.counts_map(table(spark, d, "events").select("event_type"), "event_type")
    return out.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("counts"))


@C.query("""SELECT '| event_type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY event_type) AS markdown FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def markdown_briefing(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("event_type").agg(rows_as("n"))
    return reports.markdown_table(per, ["event_type"], ["event_type", "n"])


@C.query("""WITH RECURSIVE e(parent, child) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'root', 'r' || r_regionkey FROM region),
w(url, level) AS (SELECT 'root', 0 UNION SELECT child, level + 1 FROM w JOIN e ON w.url = e.parent) SELECT url, CAST(min(level) AS INTEGER) AS level FROM w GROUP BY url""")
def sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        table(spark, d, "nation").select(s("r", "n_regionkey").alias("parent"), s("n", "n_nationkey").alias("child"))
        .unionByName(table(spark, d, "customer").select(s("n", "c_nationkey").alias("parent"), s("c", "c_custkey").alias("child")))
        .unionByName(table(spark, d, "region").select(F.lit("root").alias("parent"), s("r", "r_regionkey").alias("child")))
    )
    return markup.walk(edges, spark.createDataFrame([("root",)], "url string"))


# -- streams --------------------------------------------------------------------------------------
def _stream(spark: SparkSession, d: str, make, mode: str) -> DataFrame:
    name = f"s_{uuid.uuid4().hex}"
    out = make(pipelines.event_stream(spark, f"{d}/events.parquet"))
    return pipelines.run_to_end(out, spark, name, mode, f"{shared_dir(spark)}/newsloom/streams/{name}")


@C.query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    out = _stream(spark, d, lambda e: pipelines.tumbling_counts(e, "ts", "event_type", "value"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@C.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session_users(spark: SparkSession, d: str) -> DataFrame:
    out = _stream(spark, d, lambda e: pipelines.session_counts(e, "ts", "user_id").select("user_id", "session_window.start", "n"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@C.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda e: pipelines.first_seen(e, "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "append")


QUERIES, ORACLES = C.queries, C.oracles
