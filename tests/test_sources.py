import html as H

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls
from newsloom.operators import entities
from newsloom.sources import markup, tables

ARTICLE = """<html><head><title>Site | Title</title><meta property="og:title" content=" Real title "><meta name="author" content="A. Writer"><link rel="canonical" href="/story"></head>
<body><nav>Menu</nav><main><article><h1>Head</h1><p>First paragraph<br>goes on.<p>Second &amp; last.</article></main><div class="comments"><p>A comment that is very long, longer than the article itself, but no part of it at all.</p></div>
<div class="correction">Correction: the name of the station was wrong.</div><p>Correction: not inside an article at all, so it is none.</p><footer>foot</footer></body></html>"""


def test_article_by_its_longest_container():
    (title, body, url, published, author, notes), = markup.parse_article(ARTICLE, "https://e.example/x?a=1")
    assert (title, url, published, author) == ("Real title", "https://e.example/story", None, "A. Writer")
    assert notes == ["Correction: the name of the station was wrong."] and "Menu" not in body and "comment that" not in body and "Second & last." in body
    assert body.count("the name of the station was wrong") == 1
    assert markup.parse_article("")[0][1] == "" and markup.parse_article("just text")[0][1] == "just text"


def test_tables_with_marks_and_links():
    page = "<table><tr><td>other</td></tr></table><table id='x-table-apps'><tr><th>File Number<th>PDF</tr><tr><td><a href='/d/1'>001</a><td><a href='p.pdf'>view</a><td>more</tr><tr><td>002<br>b</td></tr></table>"
    got = markup.parse_table(page, "table-apps", "https://e.example/a/", ("file number",))
    assert got == [(0, {"File Number": "001", "Detail URL": "https://e.example/d/1", "PDF": "view", "PDF URL": "https://e.example/a/p.pdf", "Column 3": "more"}), (1, {"File Number": "002 b"})]
    assert markup.parse_table("<p>none</p>") == []


def test_errors_and_outlines(spark):
    docs = spark.createDataFrame([(1, "<opml><outline text='A' xmlUrl='u1'/><outline title='B' xmlUrl=' u2 '/></opml>"), (2, "<opml><outline text='C' xmlUrl='u1'/></opml>"), (3, "<broken"), (4, None)], "id long, t string")
    assert sorted(tuple(r) for r in markup.feed_list(docs, "id", "t").collect()) == [("u1", "A"), ("u2", "B")]
    bad = markup.parse_documents(docs, "id", "t", "outline", errors=True).where("error is not null").collect()
    assert [(r["id"], r["pos"], r["url"]) for r in bad] == [(3, None, None)]


def test_walk_has_no_depth_of_its_own(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n25", "n0")], "parent string, child string")
    root = spark.createDataFrame([("n0",)], "url string")
    assert markup.walk(edges, root).count() == 26 and markup.walk(edges, root, depth=3).count() == 4
    assert [r["url"] for r in markup.walk(edges, root, most=5).collect()] == ["n0", "n1", "n2", "n3", "n4"]


def test_csv_texts_and_keys(spark):
    df = spark.createDataFrame([(1, '﻿a, "x, y"\r\n\r\nb,z\n')], "id long, t string")
    assert [(r["line_no"], r["k"], r["v"]) for r in tables.rows_of_csv(df, "t", ["k", "v"]).collect()] == [(0, "a", "x, y"), (2, "b", "z")]
    rows = spark.createDataFrame([(2, "s1", "N1"), (3, "s1 ", "N2"), (4, "", "N3"), (5, None, None)], "line_no int, station_id string, station_name string")
    assert [r["station_name"] for r in tables.keyed(rows, "station_id", "line_no").collect()] == ["N2"]
    assert sorted(tuple(r) for r in tables.config_errors(rows).collect()) == [(4, "missing station_id"), (5, "missing station_id, station_name")]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("value", ["a &amp; b &lt;c&gt; &copy;&#233;&#x1F600;&nbsp;&nosuch; & &; &#0; &Aacute;&amp;lt;", "", "no entities", "&quot;", "x&hellip;"])
def test_entities(spark, value):
    assert one(spark, value, text.unescape) == H.unescape(value)


def test_names_titles_and_addresses(spark):
    assert [one(spark, v, text.name_from_stem) for v in ("12_WXYZ_AFR_2020", "Some-Name FSR", "Plain", "003-Radio_Town-2019", "2020")] == ["WXYZ", "Some-Name", "Plain", "Radio Town", "2020"]
    assert [one(spark, v, text.without_band) for v in ("WXYZ FM", "WXYZ", "FM")] == ["WXYZ", "WXYZ", "FM"]
    assert [one(spark, v, lambda c: text.document_title(c, F.lit("https://e.example/a/b.pdf?x=1"))) for v in ("  T  x ", "", None)] == ["T x", "b.pdf", "b.pdf"]
    assert [one(spark, v, text.safe_filename) for v in ("a b/c?.pdf", "..", None)] == ["a-b-c-.pdf", "document", "document"]
    hint = lambda c: text.publisher_hint(c, {"the daily": "daily.example"})
    assert [one(spark, v, hint) for v in ("x - The Daily", "x - news.example", "x - Somebody", "none")] == ["daily.example", "news.example", None, None]
    assert one(spark, "https://s.example/r?u=a1aHR0cHM6Ly9lLmV4YW1wbGUveA", urls.unwrapped) == "https://e.example/x"
    assert one(spark, "https://s.example/r?q=https%3A%2F%2Fe.example%2Fy", urls.unwrapped) == "https://e.example/y" and one(spark, "https://e.example/z?u=1", urls.unwrapped) == "https://e.example/z?u=1"
    assert [str(one(spark, v, dates.date_argument)) for v in ("2024-02-29", "02/29/2024", " ", None)] == ["2024-02-29", "2024-02-29", "None", "None"]
    with pytest.raises(Exception, match="not a date"):
        one(spark, "29.2.2024", dates.date_argument)


def test_headlines_that_name_a_station(spark):
    roster = spark.createDataFrame([("WABC-FM",), ("Dal Valley Public Radio",), ("Some Foundation",), (None,)], "n string")
    names = entities.headline_names(roster, "n", ("public radio",))
    items = spark.createDataFrame([(1, "WABC sold"), (2, "wabc sold"), (3, "At DAL valley public-radio"), (4, "Valley Public Radio"), (5, None), (6, "Some Foundation")], "id long, t string")
    assert sorted(r[0] for r in entities.in_headlines(items, "id", "t", names).collect()) == [1, 3]
