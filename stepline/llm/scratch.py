"""Intermediate tables of one job in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.session import scratch_path


class Scratch:
    """Tables below one new folder of ``spark.checkpoint.dir``; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The relation, written once: lineage is cut and a lost executor costs no recomputation."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until it is none of the columns (in any letter case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def some_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows (all if there are fewer), the first by a hash of their keys.

    About 2 n rows are let through by another hash before they are ordered, so that what meets
    in one task does not grow with the number of partitions.
    """
    share = min(1.0, 2 * n / max(df.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit(29), *keys), F.lit(1 << 30))
    return df.where(draw < F.lit(int(share * (1 << 30)))).orderBy(F.xxhash64(*keys), *keys).limit(n)
