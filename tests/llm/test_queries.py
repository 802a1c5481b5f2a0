"""Each query runs over whole tables; those that SQL can state equal it."""

import pytest

from newsloom.llm.queries import ORACLES, QUERIES
from tests.helpers import duck, same

COLUMNS = {
    "p1_found": ["chunk_a", "chunk_b"], "p2_found": ["item_kind", "item_id", "cut_level"], "p3_found": ["record_kind", "record_key", "station_id"], "p4_found": ["doc_id", "line_no", "noise_kind"],
    "p5_found": ["record_no", "match_kind", "match_key"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in ORACLES:
        same(df, duck(data), ORACLES[name])
    else:
        assert df.count() > 0
