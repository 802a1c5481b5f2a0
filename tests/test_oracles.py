"""Every core query that SQL can state, against DuckDB over whole tables."""

import importlib
from collections import Counter

import pytest

from newsloom.plans.registry import CORE_MODULES
from tests.helpers import duck, same

MODULES = [importlib.import_module(m) for m in CORE_MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLES[name])


def distinct(rows, *names):
    keys = [tuple(r[n] for n in names) for r in rows]
    return len(keys) == len(set(keys))


def best_first(rows, name):
    return all(a[name] >= b[name] for a, b in zip(rows, rows[1:]))


def at_most_two_a_year(rows):
    return all(n <= 2 for n in Counter(r["report_year"] for r in rows).values())


#: What must hold of the rows of the queries that have no SQL.
HOLDS = {
    "search_command": lambda rows, con: 0 < len(rows) <= 8 and distinct(rows, "id") and [r["list_no"] for r in rows] == sorted(r["list_no"] for r in rows) and all(r["content"] for r in rows),
    "feed_command": lambda rows, con: len(rows) > 50 and distinct(rows, "item_id") and best_first(rows, "best_score") and all((r["bucket"] == "high") == (r["best_score"] >= 8) for r in rows),
    "stories_command": lambda rows, con: len(rows) <= 40 and distinct(rows, "item_id") and all(r["best_score"] >= 5 for r in rows),
    "audit_command": lambda rows, con: len(rows) > 5 and {r["station_id"] for r in rows} == {r["station_id"] for r in rows if r["latest"]} and distinct(rows, "record_no"),
    "station_command": lambda rows, con: 0 < len(rows) <= 12 and at_most_two_a_year(rows) and best_first(rows, "score"),
    "p6_instants": lambda rows, con: len(rows) == sum(con.execute(f"select count(*) from {t}").fetchall()[0][0] for t in ("feed_items", "ecfs_items", "public_files_items", "articles")) and all((r["epoch_us"] is None) == (r["format"] is None) for r in rows),
    "p6_found": lambda rows, con: distinct(rows, "source_table", "row_id") and all(r["epoch_us"] is not None for r in rows),
}


def test_all_queries_without_sql_have_something_to_hold():
    assert set(HOLDS) == set(QUERIES) - set(ORACLES)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_query_without_sql(spark, data, con, name):
    assert HOLDS[name](QUERIES[name](spark, data).collect(), con)


def test_core_stands_without_the_training_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['newsloom.llm'] = None; import newsloom.plans.registry as r; import importlib; [importlib.import_module(m) for m in r.CORE_MODULES]; assert not [m for m in sys.modules if m.startswith('newsloom.llm.')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0
