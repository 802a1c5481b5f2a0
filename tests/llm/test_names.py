import itertools
import random

import pytest

from newsloom.llm.names import Roster, Words, align, deletes, edits, fold, load_roster, resolve_names, roster_variants

ROWS = [
    ("a-dal", "Dalmoor Valley Public Radio", "aka The Kettle Wave / WKXYZ", "https://www.dalmoor-public-radio.example/x"),
    ("b-dal", "Dalmor Vly Pub. Rad.", "formerly listed under WKXYZ", None),
    ("c-dal", "Dalmoor Valley Public Television", "KBDFG, branded The Anvil Hour", None),
    ("d-tor", "Torrick Bay Radio Network", None, ""),
    ("e-tor", "Torrick Bay Community Radio", "", ""),
]


@pytest.fixture(scope="module")
def roster():
    return Roster(ROWS)


@pytest.mark.parametrize(
    "name, want",
    [
        ("dalmoor.valley.public.radio", "a-dal"), ("Public Radio, Dálmoor Valley", "a-dal"), ("Valley Damloor Public Radio", "a-dal"), ("WKXYZ-FM", "a-dal"),
        ("The Kettle  Wave", "a-dal"), ("dalm_or_valley_public_radio", "a-dal"), ("Friends of Dalmoor Valley Public Television, Inc.", "c-dal"), ("D.V.P.T.", "c-dal"),
        ("Torrick Bay", None), ("Torrick Bay Radio Network", "d-tor"), ("Torrick Bay Cmty Rdo", "e-tor"), ("Torrick Bay Public Television", None),
        ("Dalmoor River Public Radio", None), ("Elsewhere Valley Public Radio", None), ("", None), (None, None), ("  ", None), ("WZZZZ", None), ("x" * 5000, None),
    ],
)
def test_typed_names(roster, name, want):
    assert roster.resolve(name) == want


FOREIGN = [
    ("1", "Ely Public Radio", None, None), ("2", "Springfield Public Radio", None, None), ("3", "Saint Louis Symphony", None, None), ("4", "Northampton Jazz Society", None, None),
    ("5", "Ürümqi Trade Guild", None, None), ("6", "Society Radio", None, None),
]


@pytest.mark.parametrize(
    "name, want",
    [
        ("Ely Public Radio", "1"), ("Spfld Public Radio", "2"), ("St. Louis Symphony", "3"), ("Northampton Jazz Soc.", "4"), ("Jazz Society, Northamptom", "4"), ("N. Jazz Society", "4"),
        ("Urumqi Trd Guild", "5"), ("Public Radio", None), ("N. J. S.", "4"), ("Society Radio", "6"), ("Louisville Symphony", None), ("Springvale Public Radio", None),
    ],
)
def test_names_of_another_roster(name, want):
    assert Roster(FOREIGN).resolve(name) == want


def test_generic_words_are_learned():
    rows = [(str(i), f"{a}ville {b} {c} Orchestra", None, None) for i, (a, b, c) in enumerate(itertools.product("Zon Kar Mip Dul Fet".split(), "Marsh Cliff".split(), "City Youth".split()))]
    roster = Roster([*rows, ("plain", "City Youth Orchestra", None, None)])
    assert roster.words.common == {"marsh", "cliff", "city", "youth", "orchestra"} and roster.words.features == {"marsh", "cliff"}
    assert roster.resolve("Zonville Mrsh Yth Orch.") == "1" and roster.resolve("Youth City Orchestra") == "plain" and roster.resolve("Zonville City Orchestra") is None


def test_rows_of_one_organisation(roster):
    assert {s: roster.find(s) for s in roster.root} == {"a-dal": "a-dal", "b-dal": "a-dal", "c-dal": "c-dal", "d-tor": "d-tor", "e-tor": "e-tor"}


def test_delete_neighbourhood_finds_all_within_one_edit():
    random.seed(1)
    words = ["".join(random.choice("abc") for _ in range(random.randint(3, 5))) for _ in range(60)]
    for a, b in itertools.combinations(words, 2):
        if edits(a, b) <= 1:
            assert deletes(a) & deletes(b)


def test_assignment_is_optimal():
    words = Words([["x", "public", "radio", "network"]] * 20)
    cost, used = align(["pub", "rad"], ["public", "radio", "network"], words.cost)
    assert cost == pytest.approx(0.2) and used == 0b011
    assert align(["radio", "radio"], ["radio"], words.cost)[0] == float("inf")
    assert fold("Z.V.P.R. B'casting") == ["zvpr", "bcasting"]


def test_labelled_names_of_the_data(spark, data):
    """Held-out accuracy: the resolver never sees the labels."""
    found = load_roster(spark.read.parquet(f"{data}/station_records.parquet"))
    rows = spark.read.parquet(f"{data}/station_aliases.parquet").where("canonical_station_id <> ''").collect()
    got = [(found.resolve(r["alias"]), r["canonical_station_id"]) for r in rows]
    wrong = sum(a is not None and a != b for a, b in got)
    assert wrong == 0 and sum(a == b for a, b in got) >= 0.98 * len(got)


def test_tables_with_nulls_and_nothing(spark):
    schema = "station_id string, station_name string, notes string, page_url string, name string"
    roster = spark.createDataFrame([(*r, "clash") for r in ROWS] + [(None, "x", None, None, None), ("z", None, None, None, None)], schema)
    typed = spark.createDataFrame([("WKXYZ", "c"), ("WKXYZ", "c"), (None, "c"), ("", "c")], "name string, station_id string")
    assert [tuple(r) for r in resolve_names(spark, typed, "name", roster).collect()] == [("WKXYZ", "a-dal")]
    assert [tuple(r) for r in roster_variants(spark, roster).collect()] == [("b-dal", "a-dal")]
    assert resolve_names(spark, typed, "name", roster.limit(0)).count() == 0
