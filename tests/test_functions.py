import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = F.lit
CASES = [
    (lambda: text.collapse(L("  a\t b  c\n")), "a b c"),
    (lambda: text.query_text(L('Find "Foo,  Bar" about the  LAB')), "find  foo   bar  about the  lab"),
    (lambda: text.query_text(L("Foo,  Bar"), True), "foo bar"),
    (lambda: text.slug(L("Hello, World!")), "hello-world"),
    (lambda: text.slug(L("!!")), "unknown"),
    (lambda: text.plain_text(L("&lt;b&gt;x&lt;/b&gt; &amp; y")), "x & y"),
    (lambda: text.stripped_html(L("<p>a &lt;b&gt;</p>")), "a <b>"),
    (lambda: text.shortened(L("one two three"), 9), "one two…"),
    (lambda: text.shortened(L("short"), 9), "short"),
    (lambda: text.curly_quotes(L('say "hi" it\'s')), "say “hi” it’s"),
    (lambda: text.headline_core(L("A - B - Source")), "a - b"),
    (lambda: text.has_term(L("the NPR board"), "npr"), True),
    (lambda: text.has_term(L("snprx"), "npr"), False),
    (lambda: text.has_any_term(L("abc"), []), False),
    (lambda: text.call_signs(L("WXYZ-FM and KABC, WXYZ-FM")), ["WXYZ-FM", "KABC"]),
    (lambda: text.call_sign_forms(L(" wxyz-fm ")), ["WXYZ-FM", "WXYZ"]),
    (lambda: text.digits(L("id 66-589")), "66589"),
    (lambda: text.org_key(L("The Friends of Foo & Bar, Inc.")), "foo bar"),
    (lambda: text.title_from_filename(L("/a/b/FY25-Audit_final.pdf")), "FY25 Audit final"),
    (lambda: text.is_named_person(L("Jane Doe leaves")), True),
    (lambda: text.first_sentence(L("This is a long enough first sentence. Next.")), "This is a long enough first sentence."),
    (lambda: text.clamp_words(L("one two of the"), 4), "one two"),
    (lambda: text.around(L("aaa needle bbb"), "needle", 4, 10), "aaa needle bbb"),
    (lambda: text.around(L("aaa"), "needle", 4, 10), None),
    (lambda: urls.normalized(L("HTTPS://Ex.Example/A/?b=2&utm_source=x&a=1#f")), "https://ex.example/A?a=1&b=2"),
    (lambda: urls.host(L("http://www.Ex.example:80/a")), "ex.example"),
    (lambda: urls.page_key(L("http://www.ex.example/")), "ex.example"),
    (lambda: urls.unwrapped(L("https://s.example/?url=https%3A%2F%2Fa.example%2Fx")), "https://a.example/x"),
    (lambda: urls.joined(L("https://a.example/x/y.html"), L("z.pdf")), "https://a.example/x/z.pdf"),
    (lambda: urls.joined(L("https://a.example/x"), L("/z.pdf")), "https://a.example/z.pdf"),
    (lambda: urls.secure(L("http://s3.example/a b.pdf"), ["s3.example"]), "https://s3.example/a%20b.pdf"),
    (lambda: urls.is_web_address(L("ftp://a.example")), False),
    (lambda: dates.latest_year(L("FY25 Audit")), 2025),
    (lambda: dates.latest_year(L("nothing"), L("FYE 2022 report")), 2022),
    (lambda: dates.latest_year(L("nothing")), None),
    (lambda: dates.date_hint(L("due March 3, 2024 or later")), "March 3, 2024"),
    (lambda: vectors.cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(0.0))), 1.0),
    (lambda: vectors.cosine(F.array(L(0.0)), F.array(L(1.0))), 0.0),
    (lambda: vectors.cosine(F.array(L(1.0)), F.array(L(1.0), L(2.0))), 0.0),
    (lambda: vectors.jaccard(F.array(L("a"), L("b")), F.array(L("b"), L("c"))), 1 / 3),
    (lambda: vectors.containment(F.array(L("a")), F.array(L("a"), L("c"))), 1.0),
    (lambda: text.collapse(L(None).cast("string")), None),
    (lambda: urls.normalized(L(None).cast("string")), None),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_expression(spark, i):
    make, want = CASES[i]
    got = value(spark, make())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_local_clock_follows_the_season(spark):
    gate = dates.local_gate(F.col("t"), "America/New_York", {"morning": ["07:00"]})
    rows = spark.createDataFrame([("2024-07-01 11:00:00",), ("2024-01-05 12:00:00",), ("2024-01-05 11:00:00",)], "s string").select(F.to_timestamp("s").alias("t"))
    assert [r["g"] for r in rows.select(gate.alias("g")).collect()] == ["morning", "morning", None]


def test_latest_anchor_is_strictly_before(spark):
    t = F.to_timestamp(L("2024-01-04 14:00:00"))  # a Thursday
    assert str(value(spark, dates.latest_anchor(t, "UTC"))) == "2024-01-01 14:00:00"
