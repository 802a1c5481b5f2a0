import pytest
from pyspark.sql import functions as F

from newsloom.operators.scoring import Rule, Rulebook
from newsloom.plans import commands as C


def test_questions():
    assert C.question_words("What is the story about WOUB funding cuts?") == ["woub", "funding", "cuts"]
    assert C.phrases_of('Find "license renewal" about the tower sale?') == ["license renewal", "tower sale", "renewal tower sale", "license renewal tower sale"]
    assert C.phrases_of("") == [] and C.asks_for_trend("How did it change over time?") and not C.asks_for_trend("Who left?")


@pytest.fixture(scope="module")
def corpus(spark):
    articles = spark.createDataFrame(
        [(1, "u1", "Tower sale approved", "2024-02-01", "the tower sale"), (2, "u2", "Budget", "2024-03-01", "nothing here"), (3, "u3", None, None, "tower sale again"), (4, "u4", "Old", "2020-01-01", "x")],
        "id long, url string, title string, published_at string, text string",
    )
    chunks = spark.createDataFrame([(10, 1, "a", [1.0, 0.0]), (11, 1, "b", [0.9, 0.1]), (20, 2, "c", [0.8, 0.6]), (30, 3, "d", [0.0, 1.0]), (40, 4, "e", [])], "id long, article_id long, content string, embedding array<double>")
    return articles, chunks


def test_search_puts_words_before_vectors(corpus):
    got = C.search_chunks(*corpus, "the tower sale", [1.0, 0.0], k=3).collect()
    assert [(r["id"], r["chunk_id"], r["list_no"]) for r in got] == [(1, 10, 0), (2, 20, 1)]
    assert got[0]["score"] == pytest.approx(1.08)


def test_search_in_a_window_and_without_hits(corpus):
    assert [r["id"] for r in C.search_chunks(*corpus, "the tower sale", [1.0, 0.0], 3, "2024-02-15").collect()] == [2]
    assert C.search_chunks(*corpus, "tower", [0.0, 0.0], 3).count() == 0


RULES = C.FeedRules(Rulebook((Rule("sale", ("sale",), 9), Rule("talk", ("talk",), 5))), aggregators=("agg.example",), suppressed=("boards.example",), job_phrases=("vacancy",))


def feed(spark, rows):
    df = spark.createDataFrame(rows, "item_id long, feed_title string, title string, link string, summary string, p string")
    return df.withColumn("published", F.col("p").cast("timestamp")).drop("p")


def test_feed_triage(spark):
    items = feed(
        spark,
        [
            (1, "A", "Station sale closes today - Source", "https://a.example/x?utm_source=q", None, "2024-01-02 10:00:00"), (2, "B", "Station sale closes today - Other", "https://agg.example/1", "", "2024-01-02 11:00:00"),
            (3, "A", "Station sale closes today - Source", "https://a.example/x", "<b>talk</b>", "2024-01-02 12:00:00"), (4, "C", "Vacancy: sale manager", "https://c.example/", "", None),
            (5, "C", "talk", "https://boards.example/1", "", None), (6, "C", "A talk undated", "https://c.example/2", "", None), (7, "C", "sale long ago", "https://c.example/3", "", "2023-01-01 00:00:00"), (8, "C", None, None, None, None),
        ],
    )
    out = C.rank_feed(items, RULES, F.lit("2024-01-03").cast("timestamp"), 72).collect()
    assert [r["item_id"] for r in out][:2] == [1, 6]
    assert (out[0]["duplicate_count"], out[0]["best_score"]) == (1, 14) and 2 not in {r["item_id"] for r in out}
    seen = spark.createDataFrame([("https://a.example/x",)], "u string")
    again = {r["item_id"] for r in C.rank_feed(items, RULES, F.lit("2024-01-03").cast("timestamp"), 72, seen).collect()}
    assert 1 not in again and 2 in again


def test_stories_told_recently_stay_away(spark):
    ranked = spark.createDataFrame([(1, "alpha beta gamma delta", "l", 9, "high"), (2, "alpha beta gamma delta epsilon", "l", 8, "high"), (3, "one two three four", "l", 8, "maybe"), (4, "low one", "l", 1, "low")], "item_id long, title string, link string, best_score int, bucket string")
    told = spark.createDataFrame([("One two three four",)], "title string")
    assert [r["item_id"] for r in C.stories_to_send(ranked, told, ("the",)).collect()] == [1]


def test_retold_stories_stay_away(spark):
    titles = ["board cuts public radio budget 5 million", "fcc approves license transfer of wtvi station", "court hears tower zoning case 3 percent", "x y"]
    ranked = spark.createDataFrame([(i, t, "l", 9 - i, "high") for i, t in enumerate(titles)], "item_id long, title string, link string, best_score int, bucket string")
    told = spark.createDataFrame([("board cuts public radio budget 5 million after long night of angry debate",), ("fcc license transfer of wtvi station proposed",), ("court hears tower zoning case 4 percent",), ("x y",)], "title string")
    assert sorted(r["item_id"] for r in C.stories_to_send(ranked, told, ("the",), groups=(("proposed",), ("approves",))).collect()) == [1, 2, 3]


def test_audit_scan_marks_the_latest(spark):
    rows = [(1, "s", "FY2023 Audit", "https://x.example/a.pdf"), (2, "s", "FY2025 Audit", "https://x.example/b.pdf"), (3, "s", "FY2025 Audit", "http://www.x.example/b.pdf"), (4, "s", "EEO", "https://x.example/e.pdf"), (5, "t", "2024 Annual Report audit", None)]
    found = spark.createDataFrame(rows, "record_no long, station_id string, title string, document_url string")
    out = C.audit_scan(found, spark.createDataFrame([], "u string"), (("audit", ("audit",)),), "audit").collect()
    assert sorted((r["record_no"], r["latest"]) for r in out) == [(1, False), (3, True), (5, True)]


def test_newsletter_order(spark):
    posts = spark.createDataFrame([("https://a.example/1", "x", "2024-01-02"), ("https://a.example/2", "y", "2024-01-03"), ("https://a.example/3", "z", "2023-01-01")], "url string, title string, date_gmt string")
    metrics = spark.createDataFrame([("https://www.a.example/1/", 5, 1), ("https://m.example/2", 9, 2)], "url string, value int, pos int")
    assert [(r["url"][-1], r["value"]) for r in C.newsletter_posts(posts, metrics, "2024-01-01").collect()] == [("2", 9), ("1", 5)]


def test_station_page(spark, data):
    docs = spark.read.parquet(f"{data}/docs.parquet")
    sid = docs.where("canonical_station_id <> ''").groupBy("canonical_station_id").count().orderBy(F.desc("count"), "canonical_station_id").first()[0]
    out = C.station_page(docs, sid, ["deficit", "antenna"]).collect()
    assert out and max(sum(x["report_year"] == y["report_year"] for y in out) for x in out) <= 2
