"""Numbered lines over many splits, and lines that are no JSON."""

import json

from stepline.session import scratch_path
from stepline.sources import steps as S
from stepline.sources.lines import numbered_lines


def one_file(spark, name, lines):
    path = scratch_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_numbers_are_those_of_the_file_in_many_splits(spark):
    lines = [f"{i} " + "x" * (i % 37) if i % 11 else "" for i in range(5000)]
    a, b = one_file(spark, "a", lines), one_file(spark, "b", lines[:700])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = numbered_lines(spark, a)
        assert rows.rdd.getNumPartitions() > 1 and spark.read.text(a).rdd.getNumPartitions() > 20
        assert [r["value"] for r in sorted(rows.collect(), key=lambda r: r["line"])] == lines
        assert sorted(r["line"] for r in rows.collect()) == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert numbered_lines(spark, b).where("line <> position").count() == 0


def test_positions_run_over_the_files_in_the_order_of_their_names(spark):
    path = scratch_path(spark, "parts")
    spark.range(100).repartitionByRange(5, "id").sortWithinPartitions("id").selectExpr("cast(id as string) as value").write.text(path)
    rows = numbered_lines(spark, path).collect()
    assert all(int(r["value"]) == r["position"] for r in rows) and len({r["file"] for r in rows}) == 5
    assert sorted(r["line"] for r in rows)[:5] == [0] * 5


def test_broken_lines_are_kept_apart(spark):
    good = {"request": {"state": "s"}, "labels": {"operation": "CLICK"}, "_meta": {"id": 1}}
    lines = [json.dumps(good), "", json.dumps(good)[:-9], "nothing", "[1, 2]", json.dumps(good), '{"other": 1}', "  "]
    path = one_file(spark, "broken", lines)
    read = S.read_steps_jsonl(spark, path)
    assert read.where("labels.operation = 'CLICK'").count() == 2 and read.count() == 3
    assert sorted((r["line"], r["value"]) for r in S.rejected_steps(spark, path).collect()) == [(2, lines[2]), (3, lines[3]), (4, lines[4])]
    bench = one_file(spark, "bench", ['{"id": "a", "request": {"x": 1}}', "{", '{"id": "b", "request": "{}"}'])
    assert sorted(r["id"] for r in S.read_bench(spark, bench).collect()) == ["a", "b"]
    assert [r["line"] for r in S.rejected_bench(spark, bench).collect()] == [1]
