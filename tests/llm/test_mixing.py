import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm.mixing import mix_sources, water_fill


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(1, 5), st.integers(0, 1000)), min_size=1, max_size=6), st.floats(1, 20_000))
def test_water_fill(rows, total):
    share = sum(r[0] for r in rows)
    targets = [(f"s{i}", w / share, r) for i, (w, r, _) in enumerate(rows)]
    plan = water_fill(targets, {f"s{i}": n for i, (_, _, n) in enumerate(rows)}, total)
    caps = sum(r * n for _, r, n in rows)
    assert all(a.tokens <= a.available * a.max_repeats + 1e-6 for a in plan)
    assert sum(a.tokens for a in plan) == pytest.approx(min(total, caps))
    free = [a for a in plan if not a.clamped and a.available]
    assert len({round(a.tokens / a.target_share, 3) for a in free}) <= 1 or max(a.tokens / a.target_share for a in free) == pytest.approx(min(a.tokens / a.target_share for a in free), rel=1e-6)


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_shares_and_repeats(spark):
    rows = [(i, "big", 10) for i in range(3000)] + [(9000 + i, "small", 7) for i in range(200)] + [(8000, None, 5), (8001, "other", 5), (8002, "big", 0), (8003, "big", None)]
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 4), ("absent", 0.0, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(spark, sizes(spark, rows), targets)
    shares = {r["source"]: r for r in mix.shares(spark).collect()}
    assert abs(shares["big"]["reached_share"] - 0.8) < 0.005 and shares["small"]["most_repeats"] <= 4 and shares["absent"]["reached_tokens"] == 0
    used = mix.records.collect()
    assert {r["source"] for r in used} == {"big", "small"} and all(r["copies"] >= 1 for r in used)
    again = mix_sources(spark, sizes(spark, rows), targets).records.collect()
    assert sorted(map(tuple, used)) == sorted(map(tuple, again))


def test_clamped_source_passes_its_share_on(spark):
    rows = [(i, "a", 10) for i in range(100)] + [(500 + i, "b", 10) for i in range(100)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    got = {r["source"]: (r["reached_tokens"], r["clamped"]) for r in mix_sources(spark, sizes(spark, rows), targets, total=3000).shares(spark).collect()}
    assert got == {"a": (1000, True), "b": (2000, False)}


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(spark, sizes(spark, []), targets)
    assert mix.records.count() == 0 and mix.shares(spark).first()["reached_share"] == 0
