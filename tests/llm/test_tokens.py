import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.tokens import Lexicon, encode_corpus, load_encoding, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no public vocabulary here")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=8), st.lists(st.integers(0, 50_000), min_size=1, max_size=4), max_size=30), st.lists(st.text(max_size=8), max_size=20))
def test_lexicon_holds_exactly_its_words(tmp_path_factory, words, others):
    words = {w: ids for w, ids in words.items() if "\ud800" > w or w.isprintable()}
    path = tmp_path_factory.mktemp("lex") / "l.bin"
    path.write_bytes(Lexicon.build(words).to_bytes())
    lexicon = Lexicon.mapped(str(path))
    asked = [*words, *others]
    for w, place in zip(asked, lexicon.lookup([w.encode() for w in asked])):
        assert (lexicon.ids_at(place) if place >= 0 else None) == words.get(w)


def test_endings_are_shared():
    words = {f"{a}{b}": [1] for a in ("re", "un", "over", "under") for b in ("cast", "casting", "caster", "casters")}
    assert len(Lexicon.build(words).final) < sum(map(len, words)) / 3


TEXTS = [None, "", " ", "\n\n", "Hello, world's don't", "a" * 30_000, "été 日本語 😀‍", "<|endoftext|> stays text", "x  y \t z\r\n", "Hello, world's don't"]


@pytest.mark.parametrize("lexicon_words", [0, 5, 65_536])
def test_ids_equal_the_public_library(spark, lexicon_words):
    encoding = load_encoding(vocabulary_path())
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(spark, df, "doc_id", "text", lexicon_words=lexicon_words).collect()}
    assert got == {i: encoding.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_whole_sample_and_counts(spark, data):
    encoding, docs = load_encoding(vocabulary_path()), spark.read.parquet(f"{data}/documents.parquet")
    want = {r["doc_id"]: encoding.encode_ordinary(r["text"] or "") for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in encode_corpus(spark, docs, "doc_id", "text").collect()} == want
    assert {r["doc_id"]: r["n_tokens"] for r in encode_corpus(spark, docs, "doc_id", "text", counts_only=True).collect()} == {k: len(v) for k, v in want.items()}


def test_empty_table(spark):
    assert encode_corpus(spark, spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
