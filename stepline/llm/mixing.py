"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.functions.hashing import uniform
from stepline.llm.scratch import Scratch, free_names

MAX_MEAN = 64.0  # a larger mean is drawn as a sum of Poisson numbers with means below this
SLACK = 80  # terms of the inversion beyond the mean: P(more | mean <= 64) < 1e-15


def poisson(mean: Column, parts: Column, draw) -> Column:
    """A Poisson number of the given mean by inversion; draw(j) is the j-th uniform number of the row."""

    def one(u: Column, m: Column) -> Column:
        start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("c"), F.lit(0).alias("n"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * m / k
            return F.when(u < s["c"], s).otherwise(F.struct(p.alias("p"), (s["c"] + p).alias("c"), k.alias("n")))

        return F.aggregate(F.sequence(F.lit(1), F.ceil(m).cast("int") + SLACK), start, step)["n"]

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda total, j: total + one(draw(j), mean / parts))


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, text_col: str, epochs: float, scratch: Scratch) -> DataFrame:
    """(source, mean, parts): how often a text of each source is expected in the mixture.

    The mixture holds epochs times the characters of docs, shared out by weight; without
    weights every source has the same share. A source without weight or without characters
    has mean zero.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()), "name string, w double")
        weighed = sizes.join(table, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    weighed = scratch.keep(weighed.withColumn("w", F.when(F.col("size") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0)), "sizes")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("w").alias("w")).first()
    mean = F.when(F.col("w") > 0, F.col("w") / F.lit(total["w"]) * F.lit(epochs * (total["size"] or 0.0)) / F.col("size")).otherwise(0.0)
    return weighed.select("source", mean.alias("mean")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / MAX_MEAN)).cast("int"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: float = 1.0, seed: int = 42, copy_col: str = "copy") -> DataFrame:
    """Every row as often as its Poisson number says, with the number of the copy, in a global shuffle.

    The number depends on seed and id alone, so a retry or another partitioning gives the same
    mixture; repeated rows and rows without id draw alike. A null source is a source of its own;
    null and empty texts count no characters and follow their source's rate. No rows give no rows.
    A column named like copy_col is replaced. Copies are dealt out by a hash and ordered by it
    within each partition. The table of rates has a row per source; Spark broadcasts it while its
    measured size allows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    plain = docs.drop(copy_col)
    of, mean, parts, n, at = free_names([*plain.columns, copy_col], "of", "mean", "parts", "n", "at")
    marks = scratch.keep(rates(docs, weights, source_col, text_col, epochs, scratch), "rates").select(F.col("source").alias(of), F.col("mean").alias(mean), F.col("parts").alias(parts))
    who = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    with_rate = plain.join(marks, F.col(source_col).eqNullSafe(F.col(of)))
    count = F.when(F.col(mean) > 0, poisson(F.col(mean), F.col(parts), lambda j: uniform(seed, who, j)))
    counted = with_rate.withColumn(n, count).where(F.col(n) > 0)
    copies = counted.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(n))))
    dealt = copies.withColumn(at, F.xxhash64(F.lit(seed), who, copy_col))
    return dealt.repartition(at).sortWithinPartitions(at).drop(of, mean, parts, n, at)
