"""Every query of the subpackage runs on the small tables; those with SQL give the same rows as DuckDB."""

import os

import pytest

from lodestone.llm import queries
from tests import oracle

COLUMNS = {
    "p2_found": {"entity_row_id_a", "entity_row_id_b"}, "p3_found": {"table_name", "row_key", "noise"}, "p4_found": {"entity_row_id", "canonical_id"},
    "p6_found": {"entity_row_id", "slot"}, "p9_found": {"doc_id"},
}


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        oracle.same(spark, queries.QUERIES[name], queries.SQL[name])
        return
    df = queries.QUERIES[name](spark, oracle.DATA)
    rows = df.collect()
    assert name not in COLUMNS or set(df.columns) == COLUMNS[name]
    assert not name.endswith("_found") or (rows and len(rows) == len(set(rows)))
