import json

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedupe, entities, joins, ranking, reports, retrieval, scoring, similarity, state
from newsloom.plans.state_queries import ORACLES
from newsloom.sources import markup, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_keep_first_and_last_with_ties_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("x", 3, "c"), ("x", 3, "c")], "k string, pos int, _row string")
    assert rows(dedupe.keep_first(df, ["k"], ["pos"]).fillna("-")) == [("-", 1, "a"), ("x", 3, "c")]
    assert rows(dedupe.keep_first(df, ["k"], ["pos"], last=True).fillna("-")) == [("-", 2, "b"), ("x", 3, "c")]


def test_upsert_counts_and_empty(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "url string, v int")
    c = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "url string, v int")
    assert rows(dedupe.upsert(t, c, "url", "v")) == [("a", 1), ("b", 4), ("c", 5)]
    assert rows(dedupe.upsert_counts(t, c, "url")) == [(1, 1, 1)]
    assert rows(dedupe.upsert(t, c.limit(0), "url", "v")) == [("a", 1), ("b", 2)]


def test_merge_groups_takes_best_and_first(spark):
    df = spark.createDataFrame([("k", 1, 5, "t1", "s2"), ("k", 2, 9, "t2", "s1"), ("k", 3, 9, "t3", "s1")], "key string, pos int, score int, title string, src string").withColumn("at", F.col("pos"))
    r = dedupe.merge_groups(df, "key", "pos", "score", "at", "src", ["title"]).first()
    assert (r["title"], r["best_score"], r["best_position"], r["latest"], r["sources"], r["duplicate_count"]) == ("t1", 9, 2, 3, ["s1", "s2"], 2)


def test_two_tier_exact_zero_blocks_the_looser_key(spark):
    left = spark.createDataFrame([("h/a", "a"), ("h/b", "b"), ("h/c", "c")], "page string, path string")
    m = spark.createDataFrame([("h/a", "a", 0, 1), ("m/a", "a", 7, 2), ("m/b", "b", 4, 3), ("m/b", "b", 5, 4)], "page string, path string, v int, pos int")
    assert rows(joins.two_tier(left, m, ("page", "path"), "v", "pos"), "page", "v") == [("h/a", 0), ("h/b", 5), ("h/c", 0)]


def test_cascade_names_the_first_tier(spark):
    df = spark.createDataFrame([(1, "W", None), (2, None, "org"), (3, None, None)], "id int, call string, org string")
    keys = lambda v: spark.createDataFrame([(v,), (None,)], "k string")
    out = joins.cascade_match(df, [("call_sign", "call", keys("W")), ("org_name", "org", keys("org"))])
    assert rows(out.fillna("-"), "id", "matched_by") == [(1, "call_sign"), (2, "org_name"), (3, "-")]


def test_ties_are_all_kept(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 2, "c"), (None, 5, "d")], "g string, r int, v string")
    assert rows(ranking.best_with_ties(df, ["g"], [F.col("r")]), "v") == [("a",), ("b",), ("d",)]


def test_gates_close_when_enough_came_before(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert rows(retrieval.gated_union([(ids(1, 2), None), (ids(2, 3), 3), (ids(9), 3)], "id")) == [(1, 0), (2, 0), (3, 1)]


@pytest.mark.parametrize("n", [0, 1, 1400, 1401, 5000])
def test_window_chunks_cover_texts_of_any_length(spark, n):
    words = ("word " * (n // 5 + 1))[:n]
    df = spark.createDataFrame([(1, "x" * n, "c"), (2, words, "c"), (3, None, "c"), (4, " \n ", "c")], "id long, text string, content string")
    got = {}
    for r in retrieval.window_chunks(df, "id", "text").collect():
        got.setdefault(r["id"], []).append((r["chunk_index"], r["content"]))
    assert set(got) == ({1, 2} if n else set())
    for chunks in got.values():
        assert [i for i, _ in chunks] == list(range(len(chunks))) and all(0 < len(c) <= 1400 for _, c in chunks)
    assert retrieval.window_chunks(df.limit(0), "id", "text").count() == 0


def test_window_spans_overlap_and_end_at_blanks():
    text = "ab cd efg " * 300
    spans = list(retrieval.window_spans(len(text), [i for i, c in enumerate(text) if c == " "], 100, 20, 50))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert c == b - 20 and text[b] == " " and 50 < b - a <= 100


def test_packed_paragraphs(spark):
    long = "One two. " * 10 + "Endless" + "x" * 80
    df = spark.createDataFrame([("Short one.\n \nAnother\n line.",), (long,), ("",), (None,), (" \n\n ",)], "t string")
    got = [r[0] for r in df.select(retrieval.packed_paragraphs(F.col("t"), 40)).collect()]
    assert got[0] == ["Short one.", "Another line."] and got[2] == [] and got[3] is None and got[4] == []
    assert " ".join(got[1]) == " ".join(long.split()) and all(len(c) <= 40 or " " not in c for c in got[1])


def test_phrase_search_counts_positions(spark):
    df = spark.createDataFrame([(1, "to be or not to be"), (2, "be to"), (3, None)], "id int, t string")
    index = retrieval.inverted_index(df, "id", "t")
    assert rows(retrieval.match_phrase(index, ["to", "be"])) == [(1,)]
    assert rows(retrieval.match_all(index, ["to", "be"])) == [(1,), (2,)]


def test_story_pairs_equal_brute_force(spark, data):
    from itertools import combinations

    stop = ("a", "the", "of")
    df = spark.read.parquet(f"{data}/feed_items.parquet").where("title is not null").select(similarity.word_set("title", stop).alias("s"))
    got = {frozenset((tuple(r["set_a"]), tuple(r["set_b"]))) for r in similarity.story_pairs(df, "s", jaccard=0.6).collect()}
    sets = {tuple(r["s"]) for r in df.collect() if len(r["s"]) >= 4}
    want = {frozenset((a, b)) for a, b in combinations(sets, 2) if len(set(a) & set(b)) >= max(4, 0.6 * len(set(a) | set(b)))}
    assert got == want


def test_story_pairs_by_the_whole_rule_equal_brute_force(spark):
    from itertools import combinations
    from random import Random

    rng = Random(3)
    made = {(tuple(sorted(rng.sample("abcdefghijklmn", rng.randint(3, 11)))), (rng.randint(0, 1),), rng.choice([(), ("5%",), ("6%",)])) for _ in range(150)}
    df = spark.createDataFrame([(list(s), list(m), list(n)) for s, m, n in made], "s array<string>, m array<int>, n array<string>")
    got = {frozenset((tuple(r[f"set_{x}"]), tuple(r[f"m_{x}"]), tuple(r[f"n_{x}"])) for x in "ab") for r in similarity.story_pairs(df, "s", ["m"], 0.55, 4, 5, 0.85, ["n"]).collect()}

    def same(a, b):
        both = len(set(a[0]) & set(b[0]))
        alike = both >= 4 and (both >= 0.55 * len(set(a[0]) | set(b[0])) or (both >= 5 and both >= 0.85 * min(len(a[0]), len(b[0]))))
        return alike and a[1] == b[1] and not (a[2] and b[2] and a[2] != b[2])

    assert len(got) > 100 and got == {frozenset(p) for p in combinations(made, 2) if same(*p)}


def test_stories_of_all_items_equal_a_plain_fold(spark):
    from random import Random

    rng = Random(4)
    made = [(i, rng.randint(0, 9), sorted(rng.sample("abcdefghijklmn", rng.randint(3, 9)))) for i in range(400)]
    made += [(400 + i, 0, [f"w{i}", f"x{i}", f"y{i}", f"z{i}"]) for i in range(5_000)]
    heads, want = [], set()
    for i, _, words in sorted(made, key=lambda x: (-x[1], x[0])):
        s = set(words)
        same = lambda h: len(s & h) >= 4 and (len(s & h) >= 0.55 * len(s | h) or (len(s & h) >= 5 and len(s & h) >= 0.85 * min(len(s), len(h))))
        story = next((j for j, h in heads if i < 400 and same(h)), i)
        if story == i and i < 400:
            heads.append((i, s))
        want.add((i, story))
    df = spark.createDataFrame(made, "i long, score int, s array<string>")
    got = similarity.greedy_stories(spark, df, "i", [-F.col("score")], "s").collect()
    assert len({x for _, x in want}) < 5_300 and {tuple(r) for r in got} == want and len(got) == len(made)


def test_terms_of_several_words_are_found(spark):
    from newsloom.functions import text

    docs = spark.createDataFrame([(1, "License renewal, and"), (2, "renewal license"), (3, ""), (4, "a license-renewal filing")], "i int, t string")
    terms = spark.createDataFrame([("license renewal",), ("filing",)], "term string")
    got = joins.token_dictionary(docs, "i", joins.word_grams(text.tokens("t"), [1, 2]), terms, "term").collect()
    assert {r["i"]: list(r["terms"]) for r in got} == {1: ["license renewal"], 4: ["filing", "license renewal"]}


def test_risk_modes_differ_after_a_soft_hit(spark):
    docs = spark.createDataFrame([("s", 1, "t", "a deficit was noted and the agreement had lapsed"), ("s", 2, "u", None)], "g string, pos int, title string, body string").where("body is not null")
    patterns = [scoring.RiskPattern("deficit", "deficit", soft=True), scoring.RiskPattern("lapsed", "had lapsed")]
    scan = lambda mode: rows(scoring.risk_scan(docs, "g", ["pos"], "title", "body", patterns, (), ("layoffs",), mode), "label", "tier")
    assert scan("break") == [("deficit", "watchlist")]
    assert scan("continue") == [("deficit", "watchlist"), ("lapsed", "higher")]


def test_streak_ends_with_a_success(spark):
    runs = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 1, False), ("c", 2, True)], "f string, t int, bad boolean")
    assert rows(state.failure_streaks(runs, "f", ["t"], F.col("bad"))) == [("a", 2), ("b", 0), ("c", 1)]


def test_remember_keeps_the_newest(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 2)], "k string, seq long")
    assert rows(state.remember(seen, spark.createDataFrame([("c", 3), ("a", 4)], "k string, seq long"), "k", "seq", 2)) == [("a", 4), ("c", 3)]


def test_validation_of_a_configuration(spark):
    df = spark.createDataFrame([("one", "https://a.example", True), ("one", "https://b.example", True), ("bad", "ftp://x", True), ("no", "", True), ("off", "https://c.example", False)], "station_id string, page_url string, enabled boolean")
    assert entities.validate_config(df, "station_id", "page_url", F.col("enabled")).first().asDict() == {"entries": 5, "enabled": 4, "malformed_urls": 1, "enabled_without_url": 1, "disabled_with_url": 1, "duplicate_ids": 1}


def test_message_batches_stay_under_the_limit(spark):
    df = spark.createDataFrame([("g", i, f"title {i} & <b>" + "x" * (400 if i == 3 else 5), "http://e.example/" + "y" * (200 if i == 4 else 3)) for i in range(20)] + [("h", 1, None, None)], "g string, pos int, title string, link string")
    line, spare = reports.message_lines(F.col("title"), F.col("link"), F.lit("e.example"), most=60)
    out = reports.message_batches(df, "g", [F.col("pos")], "pos", line, spare, limit=160).orderBy("g", "batch").collect()
    g = [r for r in out if r["g"] == "g"]
    assert all(len(r["text"]) <= 160 for r in out) and [i for r in g for i in r["items"]] == list(range(20)) and len(g) > 3
    assert all(r["text"].startswith("continued\n- ") for r in g[1:]) and "&amp; &lt;b&gt;" in g[0]["text"] and "y" * 20 not in "".join(r["text"] for r in g) and "…" in "".join(r["text"] for r in g)
    assert [r["text"] for r in out if r["g"] == "h"] == ["- <|(no title)> (e.example)"]


def test_delivery_stops_at_the_first_failure(spark):
    messages = spark.createDataFrame([("a", 0, [1, 2]), ("a", 1, [3]), ("a", 2, [4]), ("b", 0, [5])], "g string, batch int, items array<int>")
    failed = spark.createDataFrame([("a", 1)], "g string, batch int")
    assert rows(state.delivered_items(messages, ["g"], "batch", "items", failed)) == [("a", 1), ("a", 2), ("b", 5)]
    assert rows(state.next_check(messages.select("g").distinct(), failed, ["g"], F.lit(1), F.lit(9))) == [("a", 1), ("b", 9)]


def test_titles_are_remembered_for_a_while(spark):
    memory = spark.sql("select 'old' title, timestamp'2024-01-01' sent union all select 'new', timestamp'2024-01-09'")
    now = F.lit("2024-01-10").cast("timestamp")
    got = rows(state.title_memory(memory, spark.sql("select 'told' title union all select 'new'"), now).select("title", F.col("sent").cast("string")))
    assert got == [("new", "2024-01-10 00:00:00"), ("told", "2024-01-10 00:00:00")]
    skip = lambda last: spark.range(1).select(state.skip_update(F.lit(last).cast("timestamp"), now)).first()[0]
    assert skip("2024-01-09 23:30:00") and not skip("2024-01-09 23:00:00") and not skip(None)


def test_rules_are_steps_in_order(spark):
    book = scoring.Rulebook((scoring.Rule("floor", ("merger",), 8, kind="floor"), scoring.Rule("routine", ("schedule",), -3), scoring.Rule("cap", kind="cap", weight=4, where=lambda: F.col("src") == "x"), scoring.Rule("both", ("tower",), 2, needs=(("city",),), pattern="never")))
    df = spark.createDataFrame([("merger schedule", "y"), ("merger", "x"), ("tower of the city", None), ("tower", None), (None, "x")], "t string, src string")
    got = [(r["score"], r["reasons"]) for r in scoring.score(df, F.col("t"), book).collect()]
    assert got == [(5, ["floor", "routine"]), (4, ["floor", "cap"]), (2, ["both"]), (0, []), (0, ["cap"])]


def test_excerpts_of_a_question(spark):
    body = "The deficit grew by ten percent. It was noted.\n\nNothing here.\n\nThe deficit grew again.\n\nNote 5 going concern: the deficit continues."
    df = spark.createDataFrame([("a", "Audit", body, 2020), ("b", None, None, 0), ("c", "x", "", 0)], "id string, title string, t string, y int")
    got = {r["id"]: r for r in scoring.row_scores(df, "title", "t", F.col("y"), ["deficit", "audit"], ["percent"], ["confidential"], ["going concern"]).collect()}
    assert [e["score"] for e in got["a"]["excerpts"]] == [12, 6] and got["a"]["excerpts"][0]["excerpt"].startswith("going concern")
    assert got["a"]["score"] == 2 * 4 + 3 * 12 + 1 + 2 and got["b"]["score"] == got["c"]["score"] == 0


def test_risk_context_rules(spark):
    patterns = (scoring.RiskPattern("concern", "going concern", lead=("if we conclude that",), needs=("substantial doubt", "ability to continue")), scoring.RiskPattern("loan", "line of credit", soft=True, stress=("default",)))
    texts = ["there is substantial doubt; a going concern", "if we conclude that\n substantial doubt, going concern", "a going concern alone", "line of credit", "line of credit in default"]
    df = spark.createDataFrame([(str(i), "g", f"t{i}", x) for i, x in enumerate(texts)], "id string, g string, title string, t string")
    got = {r["id"]: r["tier"] for r in scoring.risk_scan(df, "g", ["id"], "title", "t", patterns).collect()}
    assert got == {"0": "higher", "1": "watchlist", "2": "watchlist", "3": "watchlist", "4": "higher"}



def test_csv_with_mark_and_missing_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿station_id,station_name,enabled\n one , One ,no\ntwo,Two,\n", encoding="utf-8")
    assert rows(tables.read_config(spark, str(tmp_path / "c.csv")), "station_id", "enabled") == [("one", False), ("two", True)]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "c.csv"), ("page_url",))


def test_payload_shapes(spark):
    texts = ['[{"id": "1"}]', '{"results": [{"id": "2"}, {"id": "3"}]}', '{"other": 1}', "broken", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, j string")
    assert rows(tables.payload_items(df, "j", "struct<id:string>").select("n", "item.id")) == [(0, "1"), (1, "2"), (1, "3")]


def test_markup_readers(spark):
    rss = "<rss><channel><title>F</title><item><title>T</title><link>https://a.example</link><pubDate>x</pubDate></item><item/></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><link rel="self" href="s"/><link rel="alternate" href="l"/><updated>u</updated></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "<html/>"), (4, "<broken"), (5, None)], "id int, x string")
    got = rows(markup.parse_documents(df, "id", "x", "feed").fillna("-"))
    assert got == [(1, 0, "F", "T", "https://a.example", "", "x"), (2, 0, "A", "(no title)", "l", "", "u")]
    page = '<title>P</title><nav>no</nav><a href=" /x.pdf ">Audited <b>PDF</b></a><table><tr><th>A</th></tr><tr><td>1</td><td>2</td></tr></table><p>Body</p>'
    df = spark.createDataFrame([(1, page)], "id int, x string")
    assert rows(markup.parse_documents(df, "id", "x", "anchors")) == [(1, 0, "Audited PDF", "/x.pdf")]
    assert len(markup.parse_anchors(page, text_nodes=True)) == 2
    assert markup.parse_documents(df, "id", "x", "table").first()["cells"] == {"A": "1", "Column 2": "2"}
    assert "no" not in markup.parse_article(page)[0][1].split() and markup.parse_article(page)[0][0] == "P"
    assert markup.parse_outline('<opml><outline text="g"><outline text="n" xmlUrl="u"/></outline></opml>') == [("n", "u")]
    assert markup.parse_sitemap("<urlset><url><loc>https://a.example/x</loc></url><url><loc>/rel</loc></url></urlset>") == [("page", "https://a.example/x")]


def test_walk_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    assert rows(markup.walk(edges, spark.createDataFrame([("a",)], "u string"))) == [("a", 0), ("b", 1), ("c", 2)]


def test_archive_tree(spark, tmp_path):
    at = tmp_path / "one" / "2026-03-04"
    at.mkdir(parents=True)
    (at / "FY25-Audit.pdf").write_bytes(b"x")
    r = tables.archive_tree(spark, str(tmp_path)).first()
    assert (r["station_id"], r["archived"], r["file_name"], r["size"]) == ("one", "2026-03-04", "FY25-Audit.pdf", 1)


def test_commit_only_after_delivery(spark, tmp_path):
    from newsloom.streaming.pipelines import SeenStore

    store = SeenStore(spark, str(tmp_path / "seen"), "id")
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    sent = []
    take = lambda df: sent.append([r["id"] for r in df.collect()]) or True
    assert not store.deliver(batch, 0, lambda df: False, "n") and store.load().count() == 0
    assert not store.deliver(batch, 0, take, "n", dry_run=True) and store.load().count() == 0
    assert store.deliver(batch, 0, take, "n") and not store.deliver(batch, 0, take, "n")
    assert store.deliver(spark.createDataFrame([("b", 3), ("c", 4)], "id string, n long"), 1, take, "n")
    assert [sorted(x) for x in sent] == [["a", "b"], ["a", "b"], ["c"]]


def test_what_a_broken_delivery_took_is_remembered(spark, tmp_path):
    from newsloom.streaming.pipelines import SeenStore

    store, sent, broken = SeenStore(spark, str(tmp_path / "seen"), "id"), [], [True]
    batch = spark.createDataFrame([(x, i) for i, x in enumerate("abcde")], "id string, n long")

    def compose(df):
        """One item a message, of the first four only: the fifth overflows."""
        return reports.message_batches(df.where("n < 4").withColumn("g", F.lit(1)), "g", [F.col("n")], "id", F.repeat("id", F.lit(4)), F.repeat("id", F.lit(4)), limit=11)

    def sink(text):
        if broken[0] and "cccc" in text:
            return False
        sent.append(text)
        return True

    assert not store.deliver_messages(batch, 7, compose, sink, "n", dry_run=True) and store.load().count() == 0
    assert not store.deliver_messages(batch, 7, compose, sink, "n") and rows(store.load(), "id") != []
    first = {r[0] for r in rows(store.load(), "id")}
    broken[0] = False
    assert store.deliver_messages(batch, 7, compose, sink, "n") and not store.deliver_messages(batch, 7, compose, sink, "n")
    assert first == {"a", "b"} and rows(store.load(), "id") == [("a",), ("b",), ("c",), ("d",)] and store.versions() == [7]
    assert [x for s in sent for x in s.split("\n") if x != "continued"] == ["aaaa", "bbbb", "cccc", "dddd"]


SESSIONS = """
import sys; sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from newsloom.session import build_session
spark = build_session(cpus=2, shuffle=4)
before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
entry.queries()["stream_session_users"](spark, "/root/testdata/sf0.1").write.parquet({out!r})
assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
"""


def test_sessions_of_a_stream_do_not_pass_the_driver(tmp_path):
    """About 10 MB of rows, while the driver takes at most 1 MB of results."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = SESSIONS.format(repo=str(Path(__file__).resolve().parents[1]), out=str(tmp_path / "out"))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.driver.maxResultSize=1m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet'")
    sql, got = ORACLES["stream_session_users"], f"SELECT user_id, start, n FROM '{tmp_path}/out/*.parquet'"
    assert con.execute(f"SELECT count(*) FROM ({got})").fetchall() == con.execute(f"SELECT count(*) FROM ({sql})").fetchall()
    assert con.execute(f"({got} EXCEPT ALL ({sql}))").fetchall() == []


def test_a_stream_in_several_batches_is_one_table(spark, tmp_path):
    from newsloom.streaming import pipelines

    events = spark.sql("select user, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, at) as ts from values ('a', 0), ('a', 20), ('b', 0), ('a', 40), ('b', 100), ('c', 5) as t(user, at)")
    for i in range(3):  # each a batch, and one session of a goes over all of them
        events.orderBy("user", "ts").offset(2 * i).limit(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = pipelines.event_stream(spark, str(tmp_path / "events"), files_per_trigger=1)
    sessions = pipelines.run_to_end(pipelines.session_counts(stream, "ts", "user"), spark, "batches_complete", "complete", str(tmp_path / "c1"))
    assert rows(sessions, "user", "n") == [("a", 3), ("b", 1), ("b", 1), ("c", 1)]
    first = pipelines.run_to_end(pipelines.first_seen(stream, "ts", ["user"], "3650 days").select("user"), spark, "batches_append", "append", str(tmp_path / "c2"))
    assert rows(first, "user") == [("a",), ("b",), ("c",)]


def test_json_keys_are_sorted_at_every_level(spark, tmp_path):
    df = spark.sql("select named_struct('z', 1, 'a', named_struct('y', 2, 'b', 3)) as s, array(named_struct('q', 1, 'c', 2)) as l, map('k', 1, 'd', 2) as m, cast(null as struct<b: int, a: int>) as n")
    reports.write_json(df, str(tmp_path / "j"))
    text = spark.read.text(str(tmp_path / "j")).first()["value"]
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")) and json.loads(text)["s"]["a"] == {"y": 2, "b": 3}


def test_reports_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    reports.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()["value"]) == {"a": "x", "b": 1}
    reports.write_csv(df, str(tmp_path / "c"), ["a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a"]
