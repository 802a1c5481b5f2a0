import random

import pytest

from newsloom.llm.history import EMPTY_DIGEST, History, accept_archive, accept_batch, accept_payloads, address_key, chunk_payload, digest_key, duplicates, near_duplicates, payloads_of, prepare, run_batches
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "a, b",
    [
        ("HTTPS://WWW.Ex.example:443/files/a%2Db.pdf?utm_source=x#top", "http://ex.example/files/a-b.pdf"), ("http://ex.example/x/../a b.pdf", "http://ex.example/a%20b.pdf"),
        ("http://ex.example/d?lang=en&id=3&gclid=1", "https://www.ex.example/d?id=3&lang=en"), ("http://ex.example:80/./a", "http://ex.example/a"),
    ],
)
def test_same_file(a, b):
    assert address_key(a) == address_key(b)


def test_different_files():
    assert len({address_key(u) for u in ("http://e.example/a?id=1", "http://e.example/a?id=2", "http://e.example/A?id=1", "http://e.example:8080/a?id=1")}) == 4
    assert address_key(None) is None and address_key("  ") is None


def test_digests(spark):
    h = "ab" * 32
    rows = [(h,), (f" SHA256:{h.upper()} ",), ("pending",), (EMPTY_DIGEST,), ("",), (None,), (h[:-1],), ("0" * 64,)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(digest_key(F.col("h"))).collect()]
    assert got == [h, h, None, None, None, None, None, None]


def test_an_edit_alters_the_chunks_around_it():
    random.seed(3)
    text = " ".join(f"w{random.randrange(10_000)}" for _ in range(400))
    a, b = chunk_payload(text), chunk_payload("x" + text)
    assert sum(n for _, n in a) == len(text) and len(a) > 10
    assert len({h for h, _ in a} - {h for h, _ in b}) <= 2
    twice = chunk_payload("ab" * 4000)
    assert len({h for h, _ in twice}) == len(twice)


def reference(archive, records):
    """Union-find over all records that had arrived with each batch, as the problem states it."""
    batches = sorted({r[1] for r in records})
    return {x for b in batches for x in arrived(archive, [r for r in records if r[1] <= b]) if records[x[0] - 1][1] == b}


def arrived(archive, records):
    root = {r[0]: r[0] for r in records}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(records):
        for b in records[:i]:
            if (a[2] and a[2] == b[2]) or ((not a[2] or not b[2]) and a[3] == b[3] and a[3]):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    out = set()
    for n, _, h, _ in records:
        if h in archive:
            out.add((n, "docs", archive[h]))
        elif find(n) != n:
            out.add((n, "audit", str(find(n))))
    return out


def test_batches_equal_union_find(spark):
    random.seed(7)
    digest = lambda k: f"a{k:02x}b" * 16
    records = []
    for n in range(1, 121):
        k = random.randrange(30)
        # one digest an address, one or two addresses a digest
        records.append((n, (n - 1) // 30, random.choice([digest(k), digest(k), None]), f"http://e.example/{k}/{random.randrange(2)}"))
    docs = [("d2", digest(3)), ("d1", digest(3)), ("d9", digest(5)), ("d0", None), (None, digest(6))]
    history = History(spark)
    accept_archive(history, spark.createDataFrame(docs, "doc_id string, sha string"), "doc_id", "sha")
    df = spark.createDataFrame([(*r, "clash") for r in records] + [(None, 0, None, None, "c")], "n long, b int, h string, u string, key string")
    got = {tuple(r) for r in run_batches(history, df, "b", "n", "h", "u").collect()}
    assert got == reference({digest(3): "d1", digest(5): "d9"}, records)


def test_an_opened_history_is_the_one_left(spark, tmp_path):
    digest = lambda k: f"a{k:02x}b" * 16
    records = [(n, (n - 1) // 10, digest(n % 13) if n % 3 else None, f"http://e.example/{n % 13}") for n in range(1, 41)]
    docs = spark.createDataFrame([("d1", digest(3))], "doc_id string, sha string")
    whole, folder = History(spark), str(tmp_path / "history")
    accept_archive(whole, docs, "doc_id", "sha")
    df = spark.createDataFrame(records, "n long, b int, h string, u string")
    want = {tuple(r) for r in run_batches(whole, df, "b", "n", "h", "u").collect()}
    accept_archive(History(spark, folder), docs, "doc_id", "sha")
    got = set()
    for b in range(4):
        history = History(spark, folder)
        assert history.version == b + 1 + (b > 2)
        rows = prepare(history, df.where(f"b = {b}"), "b", "n", "h", "u")
        got |= {tuple(r) for r in duplicates(rows, *accept_batch(history, rows)).collect()}
        if b == 2:
            history.compact()
            assert {len(p) for p in history.parts.values()} == {1}
    assert got == want and len(want) > 10


def test_what_was_not_committed_is_unknown_and_versions_are_made_once(spark, tmp_path):
    folder = str(tmp_path / "history")
    first, second = History(spark, folder), History(spark, folder)
    texts = payloads_of(spark.createDataFrame([("a", "one text"), ("b", "another")], "id string, t string"), "id", "t")
    first.append(texts.selectExpr("*", "array(chunks[0].chunk) as filed", "true as fresh"), "docs")
    assert History(spark, folder).table("docs").count() == 0
    first.commit()
    assert History(spark, folder).known("docs", texts).count() == 2
    with pytest.raises(RuntimeError):
        accept_payloads(second, "docs", texts)
    assert History(spark, folder).known("docs", texts).count() == 2


def test_near_duplicates_by_coverage(spark):
    """Planted edits, and one chunk that all payloads have; against shares counted directly."""
    random.seed(11)
    words = lambda n: " ".join(f"w{random.randrange(100_000)}" for _ in range(n))
    common = words(60)
    held = {f"h{i}": common + " " + words(150) for i in range(60)}
    new = {f"n{i}": held[f"h{i}"].replace(held[f"h{i}"][700:700 + 40 * (i % 5)], words(3 * (i % 5)) if i % 5 else "") if i % 5 else held[f"h{i}"] for i in range(20)} | {f"x{i}": common + " " + words(150) for i in range(5)}
    schema = "id string, t string"
    history = History(spark, threshold=0.6)
    accept_payloads(history, "docs", payloads_of(spark.createDataFrame(list(held.items()), schema), "id", "t"))
    asked = payloads_of(spark.createDataFrame(list(new.items()), schema), "id", "t")
    got = {(r["o"], r["owner"]): round(r["coverage"], 6) for r in history.covered("docs", asked).dropDuplicates(["key", "other"]).join(asked.selectExpr("key", "owner as o"), "key").collect()}
    want = {}
    for n, a in new.items():
        for h, b in held.items():
            x, y = dict(chunk_payload(a)), dict(chunk_payload(b))
            cover = sum(v for k, v in x.items() if k in y) / max(sum(x.values()), sum(y.values()))
            if cover >= 0.6:
                want[n, h] = round(cover, 6)
    assert got == want and len(want) >= 15 and {h for _, h in want} <= {f"h{i}" for i in range(20)}
    assert near_duplicates(history, "docs", asked, 0.6).count() == len(want)
    with pytest.raises(ValueError):
        history.covered("docs", asked, 0.5)
    assert history.table("docs").selectExpr("max(size(filed)) as n").first()["n"] < len(chunk_payload(held["h0"]))


def test_nothing_to_accept(spark):
    empty = spark.createDataFrame([], "n long, b int, h string, u string")
    assert run_batches(History(spark), empty, "b", "n", "h", "u").count() == 0
