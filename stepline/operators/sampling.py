"""Keyed samples, splits, mixes and batches.

Positions in a shuffled table come from hash ranges (``ordering``), never from one global
sort in one task; a sample of any size therefore stays distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stepline.functions.hashing import keyed, uniform_int, unit
from stepline.operators.ordering import first_per_group, hash_position, ordered_position
from stepline.session import materialize

WINDOW_ROWS = 4096  # fixed value: rows sorted by length together


def first_by_hash(df: DataFrame, hexes: Column, tie: str, n: int) -> DataFrame:
    """n rows of the table, the first in hash order."""
    return hash_position(df, hexes, tie, "_at").filter(F.col("_at") <= n).drop("_at")


def cut_fraction(df: DataFrame, hexes: Column, tie: str, fraction: float) -> DataFrame:
    """Exact cut of the shuffled table: the first int(fraction * n) rows are train, the rest dev."""
    n_train = int(fraction * df.count())
    placed = hash_position(df, hexes, tie, "_at")
    return placed.withColumn("split", F.when(F.col("_at") <= n_train, "train").otherwise("dev")).drop("_at")


def repeat_until(df: DataFrame, times: Column, skips: Callable[[Column], Column], out: str = "copy", skipped: str = "skipped") -> DataFrame:
    """Each row ``times`` times, numbered from 1, up to the first copy that ``skips`` names; that copy is marked, later ones are not made.

    A null answer of ``skips`` is no skip; a row of no times gives none.
    """
    numbers = F.sequence(F.lit(1), times)
    first = F.array_min(F.filter(numbers, lambda v: F.coalesce(skips(v), F.lit(False))))
    made = F.when(times >= 1, F.transform(F.filter(numbers, lambda v: v <= F.coalesce(first, times)), lambda v: F.struct(v.alias("v"), (v == F.coalesce(first, F.lit(0))).alias("s"))))
    return df.withColumn("_made", F.explode(made)).withColumns({out: F.col("_made.v"), skipped: F.col("_made.s")}).drop("_made")


LEVELS = 64  # heights tried at once


def water_level(counts: DataFrame, size: str, n: int) -> tuple[int, int]:
    """The largest t for which groups cut at t rows give no more than n rows in all, and how many they give.

    Each pass sums the groups under LEVELS heights in one aggregate row, so the number of passes
    grows with the logarithm of n and no list of groups is ordered.
    """
    lo, hi = 0, n + 1  # under lo rows a group all fit, under hi they may not
    given = 0
    while hi - lo > 1:
        step = -(-(hi - lo) // LEVELS)
        heights = list(range(lo + step, hi, step)) or [lo + 1]
        row = counts.agg(*[F.coalesce(F.sum(F.least(F.col(size), F.lit(h))), F.lit(0)).alias(f"h{h}") for h in heights]).first()
        fit = [h for h in heights if row[f"h{h}"] <= n]
        if fit:
            lo, given = fit[-1], row[f"h{fit[-1]}"]
        hi = min([h for h in heights if h > lo], default=hi)
    return lo, given


def stratified(df: DataFrame, group: str, hexes: Column, tie: str, n: int) -> DataFrame:
    """n rows spread over the groups, one per group and pass, groups in sorted order; all rows if there are fewer.

    The group counts alone tell the quotas: every group gives up to the water level, and what is
    left of n goes, a row each, to the first groups that have more. A group's rows are then taken
    by hash: whole hash ranges up to its quota, ordered only in the one range where the quota
    falls, so a group that holds most of the table stays spread. A null group is a group (first).
    """
    data = df.withColumns({"_hex": hexes, "_group": F.col(group)})
    counts = materialize(data.groupBy("_group").agg(F.count("*").alias("_size")), "group-sizes")
    level, given = water_level(counts, "_size", n)
    more = ordered_position(counts.where(F.col("_size") > level), ["_group"], "_place").select("_group", (F.col("_place") <= n - given).cast("long").alias("_extra"))
    asked = counts.join(more, counts["_group"].eqNullSafe(more["_group"]), "left").select(counts["_group"], "_size", (F.least("_size", F.lit(level)) + F.coalesce("_extra", F.lit(0))).alias("_quota"))
    # as many ranges as rows per range, so neither grows with the group itself
    asked = materialize(asked.where("_quota > 0").withColumn("_ranges", F.ceil(F.sqrt("_size"))).withColumnRenamed("_group", "_of"), "quotas")
    placed = data.join(asked, data["_group"].eqNullSafe(asked["_of"])).drop("_of")
    placed = placed.withColumn("_range", F.floor(unit(F.col("_hex")) * F.col("_ranges")))
    tally = placed.where("_quota < _size").groupBy("_group", "_quota", "_range").agg(F.count("*").alias("_n"))
    upto = tally.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")))
    last = upto.where("_upto >= _quota and _upto - _n < _quota").select(F.col("_group").alias("_of"), F.col("_range").alias("_last"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    marked = placed.join(last, placed["_group"].eqNullSafe(last["_of"]), "left")
    whole = marked.where("_last is null or _range < _last").select(*df.columns)
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_hex", tie))
    cut = marked.where("_range = _last").withColumn("_rank", rank).where("_rank <= _need").select(*df.columns)
    return whole.unionByName(cut)


def keep_class_and_fill(df: DataFrame, is_rare: Column, hexes: Column, tie: str, cap: int) -> DataFrame:
    """Every row of one rare class, then shuffled others up to a cap."""
    rare = df.filter(is_rare)
    rest = first_by_hash(df.filter(~is_rare), hexes, tie, max(0, cap - rare.count()))
    return rare.unionByName(rest)


def weighted_sample(df: DataFrame, keys: Sequence[str], weight: Column, u: Column, tie: str, k: Column) -> DataFrame:
    """k items per group without replacement; the draw u ** (1 / weight) orders the items."""
    w = Window.partitionBy(*keys).orderBy(F.pow(u, F.lit(1.0) / weight).desc(), tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def capped_options(
    df: DataFrame, keys: Sequence[str], is_match: Column, hexes: Column, order: str, cap: int
) -> DataFrame:
    """At most ``cap`` options per list: the wanted ones first, the rest drawn; ``order`` restores page order."""
    return first_per_group(df, keys, [is_match.desc(), hexes, F.col(order)], cap).drop("_rn")


def repeat_rows(df: DataFrame, times: Column, out: str = "copy") -> DataFrame:
    """Each row ``times`` times, numbered from 1."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), times)))


ROUNDS = 4  # of the permutation


def permuted(x: Column, side: int, seed: int | str) -> Column:
    """A permutation of the numbers below side * side: a Feistel network over two digits of base side.

    Each round swaps the digits and adds a keyed hash of one to the other, which any hash leaves
    reversible.
    """
    left, right = F.floor(x / F.lit(side)).cast("long"), x % F.lit(side)
    for k in range(ROUNDS):
        drawn = uniform_int(seed, 0, side - 1, F.lit(k), right)
        left, right = right, (left + drawn) % F.lit(side)
    return left * F.lit(side) + right


def shuffled_numbers(spark: SparkSession, n: int, first: int, seed: int | str) -> DataFrame:
    """(position, number): the first ``first`` positions (from 1) of a keyed permutation of the numbers below n.

    Only the rows asked for are made. The permutation is one of the next square; a number beyond
    n goes through it again until it is below (cycle walking), which few do: a square exceeds n
    by at most two sides.
    """
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    now = spark.range(min(first, n)).select((F.col("id") + 1).alias("position"), F.col("id").alias("number"))
    parts = []
    while True:
        now = materialize(now.withColumn("number", permuted(F.col("number"), side, seed)), "walk")
        parts.append(now.where(F.col("number") < n))
        now = now.where(F.col("number") >= n)
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def shuffled_pairs(df: DataFrame, column: str, first: int | None = None, seed: int | str = "pairs") -> DataFrame:
    """(position, a, b): ordered pairs of two different values of a column, in a keyed order, the first ones.

    Values are numbered in a keyed order; a pair is computed from its number and the names join
    by number, so neither the names nor pairs that nobody asked for are made.
    """
    names = materialize(hash_position(df.select(F.col(column).alias("name")).distinct(), keyed(seed, "name"), "name", "at"), "names")
    n = names.count()
    every = n * (n - 1)
    numbers = shuffled_numbers(df.sparkSession, every, every if first is None else first, f"{seed}-order")
    a = F.floor(F.col("number") / F.lit(max(n - 1, 1))).cast("long")
    r = F.col("number") % F.lit(max(n - 1, 1))
    told = numbers.select("position", (a + 1).alias("i"), (F.when(r >= a, r + 1).otherwise(r) + 1).alias("j"))
    left = told.join(names.select(F.col("at").alias("i"), F.col("name").alias("a")), "i")
    return left.join(names.select(F.col("at").alias("j"), F.col("name").alias("b")), "j").select("position", "a", "b")


def cut_by_budget(budget: int):
    """Greedy cut of one window, shortest first: longest length times count stays within the budget."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "position"], kind="stable")
        batch, count, out = 0, 0, []
        for n in pdf["length"]:
            if count and n * (count + 1) > budget:  # ascending: n is the longest so far
                batch, count = batch + 1, 0
            count += 1
            out.append(batch)
        return pdf.assign(batch=out)

    return cut


def length_batches(df: DataFrame, item: str, length: str, hexes: Column, budget: int) -> DataFrame:
    """item, length, window, batch: similar lengths together within windows of shuffled rows."""
    placed = hash_position(df.select(item, F.col(length).alias("length")), hexes, item)
    windows = placed.withColumn("window", F.floor((F.col("position") - 1) / WINDOW_ROWS))
    schema = StructType([*windows.schema.fields, StructField("batch", LongType())])
    return windows.groupBy("window").applyInPandas(cut_by_budget(budget), schema).drop("position")


def shard_of(position: Column, n: Column, start: int, world: int) -> Column:
    """Rank of a 0-based batch position after a resume point; null for done batches and the trimmed tail."""
    at = position - start
    left = n - start
    return F.when((at >= 0) & (at < left - left % world), at % world)
