import json

import numpy as np
import pytest

from newsloom.llm.knn import OneBitCodes, _search, most_similar, neighbour_pairs, parse_vectors, rotation


def make(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding_json string, vec string")


def brute(ids, v, k, floor):
    s = v @ v.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in np.flatnonzero(s[i] >= floor))[:k]
        out |= {(min(ids[i], j), max(ids[i], j)) for _, j in near}
    return out


def test_unusable_vectors_give_no_rows(spark):
    good = json.dumps([0.5] * 4)
    bad = [None, "", "[]", "failed", "[1,2]", "[0,0,0,0]", "[1,2,3,null]", '["1","2","3","4"]', "[true,1,1,1]", "[1e999,1,1,1]", '{"a":1}']
    df = make(spark, [(1, good, "x"), (None, good, "x"), *[(10 + i, b, "x") for i, b in enumerate(bad)]])
    assert [r["id"] for r in parse_vectors(df, "id", "embedding_json", 4).collect()] == [1]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 64))
    v = np.concatenate([base + 0.25 * rng.standard_normal(base.shape) for _ in range(3)])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = make(spark, [(i, json.dumps((x * rng.choice([0.5, 1, 8])).tolist()), None) for i, x in enumerate(v)])
    got = {(r[0], r[1]) for r in neighbour_pairs(most_similar(spark, df, "id", "embedding_json")).collect()}
    want = brute(list(range(len(v))), v, 5, 0.85)
    assert len(want) > 300 and got <= want and len(got & want) >= 0.9 * len(want)


def test_equal_vectors_take_the_smallest_ids(spark):
    v = json.dumps([1.0] + [0.0] * 63)
    df = make(spark, [(i, v, None) for i in range(1, 13)])
    out = most_similar(spark, df, "id", "embedding_json").collect()
    assert {r["other"] for r in out if r["id"] == 12} == {1, 2, 3, 4, 5}
    assert {r["other"] for r in out if r["id"] == 2} == {1, 3, 4, 5, 6}
    assert all(r["similarity"] == 1.0 for r in out) and len(out) == 60


def test_empty_table(spark):
    assert most_similar(spark, make(spark, []), "id", "embedding_json").count() == 0


def test_hot_cells_are_split_with_little_loss(spark, monkeypatch):
    import newsloom.llm.knn as knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "QUERY_ROWS", 60)
    rng = np.random.default_rng(5)
    v = rng.standard_normal(64) + 0.3 * rng.standard_normal((400, 64))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = make(spark, [(i, json.dumps(x.tolist()), None) for i, x in enumerate(v)])
    vectors = parse_vectors(df, "id", "embedding_json", 64).withColumnRenamed("id", "rep")
    first, n = knn.first_cells(spark, vectors.withColumnRenamed("rep", "id"), vectors, 400, 64, 5, 0.85, 4, 7)
    cells = knn.split_hot_cells(spark, first, n, 64, 7)
    assert n < 10 and cells.groupBy("home").count().agg({"count": "max"}).first()[0] <= 40
    got = {(r[0], r[1]) for r in neighbour_pairs(most_similar(spark, df, "id", "embedding_json")).collect()}
    want = brute(list(range(400)), v, 5, 0.85)
    assert len(got & want) >= 0.9 * len(want)


def test_dense_cells_stay_small_in_memory():
    """All pairs of a full task are over the floor; only those that may be among the best are compared."""
    import tracemalloc

    rng = np.random.default_rng(6)
    v = (rng.standard_normal(64) + 0.01 * rng.standard_normal((4096, 64))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    i, j, s = _search(v, v[:1024], rotation(64, 7), 0.85, 5, np.arange(1024))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and (i != j).all()
    exact = v[:1024].astype(float) @ v.T.astype(float)
    exact[np.arange(1024), np.arange(1024)] = -1
    want = {(a, b) for a in range(1024) for b in np.argsort(-exact[a])[:5]}
    assert len(want & set(zip(i.tolist(), j.tolist()))) >= 0.98 * len(want)


@pytest.mark.parametrize("dim", [16, 64])
def test_error_bound_holds(dim):
    rng = np.random.default_rng(1)
    m, q = rng.standard_normal((500, dim)).astype(np.float32), rng.standard_normal((50, dim)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    value, error = OneBitCodes(m, m.mean(axis=0), rotation(dim, 2)).estimate(q)
    assert (np.abs(value - q @ m.T) <= error).mean() > 0.95
