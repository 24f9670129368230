"""Every registered query against its SQL over the same tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    ok, message = compare(spark, duck, name, QUERIES[name], SQL.get(name), SF)
    assert ok, message


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert {"technique", "task_id", "compliance_score", "coverage", "excess_ratio"} <= set(df.columns)
    assert df.count() == 7 * 8
