"""Every registered query of the core runs; those with SQL give the same rows as DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

LLM = {"p2", "p3", "p4", "p6", "p7", "p8", "p9"}
NAMES = [n for n in entry.queries() if n.split("_")[0] not in LLM]


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    sql = entry.oracle_sql().get(name)
    if sql:
        oracle.same(spark, entry.queries()[name], sql)
    else:
        df = entry.queries()[name](spark, oracle.DATA)
        assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
