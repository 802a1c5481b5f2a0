import random

import numpy as np
import pytest

from newsloom.llm import spans
from newsloom.llm.spans import anchors, gram_hashes, gram_range, shared_report, shared_spans


def brute(texts, least):
    held = {}
    for i, t in texts:
        for p in range(len(t or "") - least + 1):
            held.setdefault(t[p : p + least], set()).add(i)
    out = set()
    for i, t in texts:
        run = None
        for p in range(len(t or "") - least + 1):
            if len(held[t[p : p + least]]) > 1:
                if run and p <= run[1]:
                    run[1] = p + least
                else:
                    if run:
                        out.add((i, *run))
                    run = [p, p + least]
        if run:
            out.add((i, *run))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(2, 7)))
    stock = [" ".join(word() for _ in range(rng.randint(15, 80))) for _ in range(6)]
    texts = []
    for i in range(n):
        parts = [rng.choice(stock)[rng.randint(0, 60) :] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 5))]
        texts.append((i, " ".join(parts)))
    return [*texts, (1000, texts[0][1]), (1001, None), (1002, ""), (1003, "ab" * 300), (1004, "x" + "ab" * 300), (1005, "q" * 159), (1006, "q" * 159)]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, h string")
    return {(r["doc_id"], r["start_pos"], r["end_pos"]) for r in shared_spans(spark, df, "doc_id", "text").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    texts = corpus(seed)
    want = brute(texts, 160)
    assert len(want) > 10 and found(spark, texts) == want


def test_hot_anchors_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_KINDS", 1)
    texts = corpus(3)
    assert found(spark, texts) == brute(texts, 160)


def test_sketch_lets_few_unique_anchors_pass_at_any_size(spark, monkeypatch):
    """Ranges a thousandth of the usual size, as many as 30 GB of texts would have."""
    monkeypatch.setattr(spans, "RANGE_ANCHORS", (64, 128))
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abcdefghij ") for _ in range(4000))) for i in range(200)]
    texts.append((999, "x" * 80 + texts[0][1][:2000]))
    rows = spans.staged(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(4), "t")
    ranges, bits = spans.sketch_shape(sum(len(t) for _, t in texts), 160)
    uri = spans.sketch_repeats(spark, rows, 160, ranges, bits)
    assert ranges > 150
    told = np.concatenate([spans.told_repeats(uri, p)[0] for p in range(8)])
    place = spans._place(anchors([t for _, t in texts], 160)[2], ranges)
    uniq, n = np.unique(place, return_counts=True)
    passed = np.isin(uniq, told)
    assert passed[n > 1].all() and (n > 1).sum() > 40 and passed[n == 1].mean() < 0.1


def test_texts_that_change_between_readings_are_noticed(spark, monkeypatch):
    df = spark.createDataFrame([(1, "k" * 200), (2, "k" * 200)], "doc_id long, text string")
    monkeypatch.setattr(spans, "told_repeats", lambda uri, part: (np.zeros(0, np.uint64), 7))
    with pytest.raises(Exception, match="changed between two readings"):
        shared_spans(spark, df, "doc_id", "text").collect()


def test_files_are_cut_alike_in_both_readings(spark):
    key = "spark.sql.files.minPartitionNum"
    with spans.same_splits(spark):
        assert int(spark.conf.get(key)) >= 1
    assert spark.conf.get(key, None) is None


def test_every_shared_stretch_has_a_common_anchor():
    rng = random.Random(4)
    core = "".join(rng.choice("abcdefgh ") for _ in range(160))
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(200)) + core + "z" * 50 for _ in range(2))
    owner, _, h, _, _ = anchors([a, b], 160)
    assert set(h[owner == 0]) & set(h[owner == 1])


def test_hashes_of_any_length_agree():
    v = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    v[200:300] = v[50:150]
    for n in (1, 7, 64, 96, 100):
        h = gram_hashes(v, (n,))[n]
        assert len(h) == 400 - n + 1 and h[200] == h[50]
    r = gram_range(v, np.array([50, 200, 50]), np.array([150, 300, 149]))
    assert r[0] == r[1] != r[2]


def test_report_and_empty_table(spark):
    df = spark.createDataFrame([(1, "k" * 200), (2, "k" * 200), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_spans"], r["shared_chars"], r["shared_part"]) for r in shared_report(shared_spans(spark, df, "doc_id", "text"), df, "doc_id", "text").collect()}
    assert got == {1: (1, 200, 1.0), 2: (1, 200, 1.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}
    assert shared_spans(spark, df.limit(0), "doc_id", "text").count() == 0
