import pytest
from pyspark.sql import functions as F

from newsloom.operators import fulltext as T

TEXTS = [
    (1, "Board meets", "The café board approved a budget for the new tower."), (2, "Tower sale", "A budget, then many many many many many many words, and the board."), (3, None, "naïve BOARD budget board"), (4, "x", None), (5, "", ""), (6, "Refinancing", "Fiscal year ended; year fiscal."),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fts") / "index")
    docs = spark.createDataFrame([(*t, "clash") for t in TEXTS], "id long, title string, text string, token string")
    T.write_index(T.token_index(docs, "id", ["title", "text"]), path)
    return T.open_index(spark, path)


@pytest.mark.parametrize(
    "query, want",
    [
        ("cafe", {1}), ("CAFÉ board", {1}), ("board budget", {1, 2, 3}), ("board AND NOT", None), ("budget NOT tower", {3}), ('"budget board"', {3}), ('"fiscal year"', {6}), ("refinanc*", {6}), ('"a budg"*', {1, 2}), ("title:tower", {2}), ("title:board OR title:tower", {1, 2}),
        ("NEAR(board budget, 3)", {1, 3}), ("NEAR(board budget)", {1, 2, 3}), ("(tower OR refinancing) NOT sale", {1, 6}), ("tower OR fiscal NOT refinancing", {1, 2}), ("nothing", set()), ("", None), ("(board", None), ("board)", None), ("NEAR(", None), ("--", None),
    ],
)
def test_queries(index, query, want):
    if want is None:
        with pytest.raises(ValueError):
            T.search(index, query)
    else:
        assert {r["id"] for r in T.search(index, query).collect()} == want


def test_lookup_is_pushed_to_the_files(index):
    assert "token" in T.search(index, "board")._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1][:120]


def test_rows_in_order_and_empty_tables(spark, index):
    docs = spark.createDataFrame(TEXTS, "id long, title string, text string")
    assert [r["id"] for r in T.first_rows(docs, "id", T.search(index, "board"), 2).collect()] == [1, 2]
    none = T.token_index(docs.limit(0), "id", ["title", "text"])
    assert T.search(none, "board OR tower").count() == 0


def test_folding_agrees_in_both_engines(spark):
    words = ["Ångström", "ÉCOLE", "Niño", "Straße", "İstanbul", "Łódź", "plain", "ﬁ"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.folded(F.col("w"))).collect()]
    assert got[:3] == ["angstrom", "ecole", "nino"] == [T.fold(w) for w in words[:3]] and got[6] == "plain"
