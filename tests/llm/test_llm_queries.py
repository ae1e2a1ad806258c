"""The registered queries against their SQL, and the pipeline against its stages."""

import os
import sys

import pytest
from oracle_check import compare
from pyspark.sql import functions as F

from stepline.llm import decontam, simhash
from stepline.llm.queries import QUERIES, SQL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, folder, key):
    ok, note = compare(spark, folder, QUERIES[key], SQL.get(key))
    assert ok, note


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES if k.startswith("op")}
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_stages_keep_their_promises(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == docs.columns, name
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0, name
        before = after
    assert decontam.contaminated(before, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
    near = simhash.near_duplicates(before)
    assert near.count() == near.select("root").distinct().count()
    mixed = p.STAGES[-1][1](spark, before, folder)
    assert mixed.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert before.where(F.col("n_chars") != F.length("text")).count() == 0
