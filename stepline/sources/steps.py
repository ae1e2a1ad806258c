"""Labelled step rows: JSON lines and parquet, by split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepline.sources.lines import parsed, rejected_lines

# request and _meta stay JSON text: their inner shape differs per source
STEP_SCHEMA = T.StructType(
    [
        T.StructField("request", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("soft_labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_meta", T.StringType()),
    ]
)

# fixed values: the published step table
FLAT_INTS = ["n_elements", "n_recent_actions"]
FLAT_COLUMNS = [
    "id", "url", "title", "goal", "n_elements", "n_recent_actions", "operation", "target_question", "target",
    "target_element", "source", "collection", "website", "task_id", "episode_id", "actor", "teacher", "reason",
    "request", "labels", "meta",
]
SPLIT_ALIASES = {"dev": ["validation"], "validation": ["dev"]}


def read_steps_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One step per line; blank lines do not count. Mixed-type labels arrive as text.

    Lines that are no JSON object are left out here; ``rejected_steps`` has them.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parsed(lines, STEP_SCHEMA).where("not broken").select("row.*")


def rejected_steps(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that ``read_steps_jsonl`` leaves out."""
    return rejected_lines(spark, path, STEP_SCHEMA)


def read_steps_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Published parquet steps: only the three JSON columns are read."""
    raw = spark.read.parquet(path).select("request", "labels", "meta")
    return raw.select(
        "request", F.from_json("labels", "map<string,string>").alias("labels"), F.col("meta").alias("_meta")
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def split_path(spark: SparkSession, folder: str, split: str) -> str:
    """Where a split lives: JSON lines before parquet; dev and validation are one split."""
    for name in [split, *SPLIT_ALIASES.get(split, [])]:
        for ending in (".jsonl", ".parquet"):
            if path_exists(spark, f"{folder}/{name}{ending}"):
                return f"{folder}/{name}{ending}"
    return f"{folder}/{split}.jsonl"


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    path = split_path(spark, folder, split)
    return read_steps_parquet(spark, path) if path.endswith(".parquet") else read_steps_jsonl(spark, path)


BENCH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "bench_subset", "source", "request", "labels")])


def rejected_bench(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the JSON lines that ``read_bench`` leaves out."""
    return rejected_lines(spark, path, BENCH_SCHEMA)


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """Bench rows from parquet or JSON lines; the request may be an object or JSON text.

    Lines that are no JSON object are left out here; ``rejected_bench`` has them.
    """
    wanted = BENCH_SCHEMA.fieldNames()
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
        present = [c for c in wanted if c in raw.columns]
        raw = raw.select(*present)
    else:
        lines = spark.read.text(path).filter(F.trim("value") != "")
        raw = parsed(lines, BENCH_SCHEMA).where("not broken").select("row.*")
    have = set(raw.columns)
    names = [F.nullif(F.col(c), F.lit("")) for c in ("bench_subset", "source") if c in have]
    return raw.select(
        F.col("id") if "id" in have else F.lit(None).cast("string").alias("id"),
        F.coalesce(*names, F.lit("all")).alias("subset"),
        "request",
        F.from_json("labels", "map<string,string>").alias("labels"),
    )


def write_splits(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> DataFrame:
    """One folder per split; returns split and row count of what was written."""
    df.write.mode(mode).partitionBy("split").format(fmt).save(path)
    reader = df.sparkSession.read.schema(df.schema)
    return reader.format(fmt).load(path).groupBy("split").agg(F.count("*").alias("rows"))


def flat_schema_columns(df: DataFrame, extra: Sequence[str] = ()) -> list[Column]:
    """The published columns in order, absent ones as null."""
    have = set(df.columns)

    def one(c: str) -> Column:
        kind = "int" if c in FLAT_INTS else "string"
        return (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)

    return [one(c) for c in [*FLAT_COLUMNS, *extra]]


def write_flat_steps(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """The fixed step table as zstd parquet, one folder per config and split."""
    out = df.select("config", "split", *flat_schema_columns(df))
    out.write.mode(mode).option("compression", "zstd").partitionBy("config", "split").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("config", "split").agg(F.count("*").alias("rows"))


def content_digest(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Digest of a set of rows, whatever their order and file layout.

    Row digests are added up in two 52-bit lanes, so a split of any size is a partial sum
    per task and never a list.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    lane = lambda at: F.conv(F.substring("_h", at, 13), 16, 10).cast("decimal(38,0)")
    sums = (
        df.select(*by, row.alias("_h"))
        .groupBy(*by)
        .agg(F.count("*").alias("rows"), F.sum(lane(1)).alias("_a"), F.sum(lane(14)).alias("_b"))
    )
    return sums.select(*by, "rows", F.sha2(F.concat_ws(":", "rows", "_a", "_b"), 256).alias("digest"))
