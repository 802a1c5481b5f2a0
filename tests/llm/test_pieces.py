import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.pieces import boundaries, cut_level, cut_positions, paragraphs, sentences, split_oversized


def pieces(text, limit=1400, overlap=220, least=500):
    p, s, w, points = boundaries(text)
    out, begin = [], 0
    for end, _ in cut_positions(points, (p[:, 1], s[:, 1], w[:, 1]), limit, overlap, least):
        out.append(text[begin:end])
        begin = end - overlap
    return out


def level(text, limit):
    return cut_level(*boundaries(text)[:3], limit)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r\t!é😀", max_size=900))
def test_pieces_fit_and_give_the_text_back(text):
    out = pieces(text, 100, 20, 30)
    assert all(len(p) <= 100 for p in out)
    assert "".join([*out[:1], *(p[20:] for p in out[1:])]) == text


def test_sentence_ends():
    text = "Dr. Smith paid $3.5 million to the U.S. office at 9 a.m. Monday. Did it help? “It did.” Yes."
    assert [text[a:b] for a, b in sentences(text, 0, len(text))] == ["Dr. Smith paid $3.5 million to the U.S. office at 9 a.m. Monday.", "Did it help?", "“It did.”", "Yes."]


def test_paragraphs_by_any_line_end():
    text = "a\r\n \t\r\nb\nb2\n\n\n c \r\rd"
    assert [text[a:b] for a, b in paragraphs(text)] == ["a", "b\nb2", "c", "d"]


def test_levels():
    assert level("x. " * 50 + "\n\n" + "y", 200) == "paragraph"
    assert level("Word here. " * 50, 100) == "sentence"
    assert level("word " * 50, 100) == "word"
    assert level("w" * 101, 100) == "none"


def test_an_edit_changes_only_neighbours():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(6000)]
    text = " ".join(w + ("." if i % 13 == 0 else "") for i, w in enumerate(words))
    a, b = pieces(text), pieces(text[:20_000] + "inserted " + text[20_000:])
    assert len(set(a) - set(b)) <= 4


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "short", "c"), (4, "w" * 3000, "c"), (4, "w" * 3000, "c"), (None, "w" * 3000, "c")]
    out = split_oversized(spark.createDataFrame(rows, "id long, text string, piece string"), "id", "text").collect()
    assert {r["item_id"] for r in out} == {4} and {r["cut_level"] for r in out} == {"none"} and len(out) % 2 == 0
    assert split_oversized(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_one_line_end_is_no_paragraph(end):
    text = f"one{end}two{end}{end}three{end} \t{end}four{end}five"
    assert [text[a:b].split() for a, b in paragraphs(text)] == [["one", "two"], ["three"], ["four", "five"]]
