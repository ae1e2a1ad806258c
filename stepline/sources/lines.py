"""Lines of text files with their numbers, read in as many splits as Spark likes.

A split knows its file and where it starts; how many lines the splits before it hold is a prefix
sum over one small row per split, so no task reads a file from its beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, position, value): line counts from 0 in its file, position from 0 over all files in the order of their names.

    Blank lines count. Both passes over the files plan the same splits.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = read.withColumn("_at", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    in_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    over_all = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "start", "_first", *[F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(c) for w, c in ((in_file, "_lines"), (over_all, "_rows"))])
    here = F.col("_at") - F.col("_first")
    return rows.join(before, ["file", "start"]).select("file", (here + F.col("_lines")).alias("line"), (here + F.col("_rows")).alias("position"), "value")


def parsed(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """lines with ``row``, the JSON object of the line, and ``broken``: it is none, or not of this shape."""
    mark = "_broken"
    while mark in schema.fieldNames():
        mark = f"_{mark}"
    wide = T.StructType([*schema.fields, T.StructField(mark, T.StringType())])
    told = lines.withColumn("row", F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark}))
    # a line that is no object at all gives no row; one that is cut off, its text in the extra field
    return told.withColumn("broken", F.col("row").isNull() | F.col(f"row.{mark}").isNotNull()).withColumn("row", F.struct(*[F.col(f"row.{f}").alias(f) for f in schema.fieldNames()]))


def rejected_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, value) of the lines that a reader with this schema leaves out; blank lines are none."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return parsed(rows, schema).where("broken").select("file", "line", "value")
