"""Every registered query runs; those with SQL give the same columns, types and rows in DuckDB."""

import pytest
from oracle_check import compare

from stepline.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, folder, key):
    ok, note = compare(spark, folder, QUERIES[key], SQL.get(key))
    assert ok, note


def test_entry_is_the_bench_report(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert "step_success" in df.columns and df.count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
