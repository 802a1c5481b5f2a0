from collections import Counter

import numpy as np
import pytest

from newsloom.llm.scans import CONFUSIONS, LABELS, LineModel, count_tokens, looks_unpaged, misread_words, noise_lines, page_noise, paragraphs_of, readable_paragraphs, readings, train_model, typeset, vocabulary
from newsloom.session import staged


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/docs.parquet").where("content_text <> ''").select("content_text").orderBy("doc_id").collect()
    return [r[0] for r in docs if looks_unpaged(r[0])]


@pytest.mark.parametrize("headings", [("Notes to Financial Statements", "Dalmoor Valley Public Radio"), ("ANNUAL ACCOUNTS OF THE HARBOUR TRUST", "Minutes, Session 4 - Draft for comment")])
def test_line_model_on_held_out_pages(plain, headings):
    """Headings that training doesn't know; page marks and breaks."""
    half = len(plain) // 2
    model, rng = train_model(plain[:half]), np.random.default_rng(99)
    hits, found, true = Counter(), Counter(), Counter()
    for i, text in enumerate(plain[half:]):
        lines, truth = typeset(text, headings[i % 2], rng)
        got = model.label(lines)
        for kind in ("break", "mark"):
            g, w = ({(k, v) for k, v in x.items() if (v == "break") == (kind == "break")} for x in (got, truth))
            hits[kind] += len(g & w)
            found[kind] += len(g)
            true[kind] += len(w)
    for kind in true:
        assert true[kind] > 30 and hits[kind] / found[kind] > 0.95 and hits[kind] / true[kind] > 0.95, kind


def test_chain_is_trained_as_a_whole():
    """The gradient that training follows is that of the likelihood of whole labellings."""
    lines = ["First line of it goes", "on here.", "", "Another one", "7"]
    model = LineModel.train([(lines, {0: "break", 3: "break", 4: "page_number"})] * 4, rounds=80, ridge=0.01)
    assert model.label(lines) == {0: "break", 3: "break", 4: "page_number"}
    assert model.pairs[LABELS.index("break"), LABELS.index("page_number")] > model.pairs[LABELS.index("page_number"), LABELS.index("break")]


def test_empty_texts_have_no_lines():
    model = train_model([])
    assert isinstance(model, LineModel) and model.label([]) == {} and model.label(["", "  "]) == {}


def test_readings_undo_each_confusion():
    for right, wrong in CONFUSIONS:
        assert f"xy{right}zw" in readings(f"xy{wrong}zw")


def test_words_at_broken_ends_arent_counted():
    total = Counter()
    count_tokens("one two thr-\nee four.\n\x0c\nre-\n\n con- \nstruct non-\nlast a-b end-", total)
    assert +total == Counter(["one", "two", "four.", "a-b"])


def test_paragraphs_go_on_over_pages():
    text = "The first line of a paragraph that goes\n12\n\x0c\nHEADING\non after the page with a bro-\nken word.\n\nNext m1llion."
    marks = [{"line_no": 2, "noise_kind": "page_number", "typed": None, "meant": None}, {"line_no": 4, "noise_kind": "running_line", "typed": None, "meant": None}]
    marks += [{"line_no": 1, "noise_kind": "break", "typed": None, "meant": None}, {"line_no": 8, "noise_kind": "break", "typed": None, "meant": None}]
    marks += [{"line_no": 5, "noise_kind": "broken_word", "typed": "bro", "meant": "ken"}, {"line_no": 8, "noise_kind": "misread", "typed": "m1llion", "meant": "million"}]
    assert paragraphs_of(text, marks) == ["The first line of a paragraph that goes on after the page with a broken word.", "Next million."]


def test_whole_operator(spark):
    body = [f"The committee number{chr(97 + i % 26)} reviewed the filing and the reserve before the board" for i in range(40)]
    clean = "\n".join(body) + "\nnon-federal money and non-federal board here\nnon-federal reserve again today"
    noisy = "\n".join(["The cornmittee reviewed the fil-", "ing before the cost of non-", "federal money rose", *body[:20], "- 4 -", *body[20:], "- 5 -"])
    rows = [(str(i), clean, "x") for i in range(30)] + [("n1", noisy, "x"), ("n2", noisy, "x"), ("nul", None, "x"), ("emp", "", "x"), ("one", "word", "x")]
    noise, texts = page_noise(spark, spark.createDataFrame(rows, "doc_id string, content_text string, text string"), "doc_id", "content_text")
    got = {(r["doc_id"], r["line_no"], r["noise_kind"]) for r in noise_lines(noise).collect()}
    want = {(d, *x) for d in ("n1", "n2") for x in ((1, "misread"), (1, "broken_word"), (24, "page_number"), (45, "page_number"))}
    assert got == want
    out = [r["paragraph"] for r in readable_paragraphs(noise, texts).where("doc_id = 'n1'").collect()]
    assert len(out) == 1 and out[0].startswith("The committee reviewed the filing before the cost of non-federal money rose The committee")


def test_empty_table(spark):
    noise, texts = page_noise(spark, spark.createDataFrame([], "doc_id string, content_text string"), "doc_id", "content_text")
    assert noise_lines(noise).count() == 0 and readable_paragraphs(noise, texts).count() == 0


def test_misread_words_dont_depend_on_the_number_of_rows(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/docs.parquet").where("content_text <> ''").selectExpr("content_text as text")
    words = staged(spark, vocabulary(texts), "words")
    once, often = [{r["word"]: r["meant"] for r in misread_words(spark, words.selectExpr("word", f"n * {k} as n")).collect()} for k in (1, 40)]
    assert len(once) > 20 and once == often
