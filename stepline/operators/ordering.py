"""Positions, running totals and order statistics without a one-task sort.

A window without a partition key would send the whole table to one task. Here a table is
first cut into ranges of its order key; only one small row per range is ever ordered
globally, and the rows themselves are ordered range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions.hashing import unit
from stepline.session import materialize

ACCURACY = 100_000  # of the quantile sketch: its error is a row in so many


def range_count(df: DataFrame) -> int:
    """Ranges to cut a table into: a small multiple of the shuffle partitions."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_range(hexes: Column, ranges: int) -> Column:
    """Range of a hex digest; ranges ascend with the digest."""
    return F.floor(unit(hexes) * ranges).cast("int")


def value_range(df: DataFrame, column: str, ranges: int) -> DataFrame:
    """Adds ``_range`` by cuts of a whole-number column that hold about equally many rows.

    The cuts come from a quantile sketch, so clustered values do not end up in one range.
    """
    n = ranges
    points = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), points, 10 * n)).first()[0] if n > 1 else []
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    numbered = df.withColumn("_value", F.col(column).cast("double"))
    placed = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket").transform(numbered)
    return placed.withColumn("_range", F.col("_bucket").cast("int")).drop("_value", "_bucket")


def add_totals_before(df: DataFrame, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """For every range: the sums over all earlier ranges, as ``_before_<name>``.

    ``df`` carries ``_range``. The partial sums are one row per (by, range).
    """
    per = df.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    return df.join(before, [*by, "_range"])


def with_position(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """1-based global position. ``df`` carries ``_range``, which must ascend with ``order``."""
    counted = add_totals_before(df, {"n": F.lit(1)})
    w = Window.partitionBy("_range").orderBy(*order)
    return counted.withColumn(out, F.row_number().over(w) + F.col("_before_n")).drop("_range", "_before_n")


def hash_position(df: DataFrame, hexes: Column, tie: str, out: str = "position") -> DataFrame:
    """1-based position in the order of a keyed hash: a shuffle of the whole table."""
    ranged = df.withColumn("_hex", hexes).withColumn("_range", hash_range(F.col("_hex"), range_count(df)))
    return with_position(ranged, ["_hex", tie], out).drop("_hex")


def line_position(df: DataFrame, column: str, out: str = "position") -> DataFrame:
    """1-based position in the order of a whole-number column with distinct values."""
    return with_position(value_range(df, column, range_count(df)), [column], out)


PARTITION_BITS = 33  # of monotonically_increasing_id: places of the rows of a partition stand below


def ordered_position(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """1-based position in the order of any columns; the rows, cut into ranges of that order, are written once."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    cut = ranged.withColumn("_range", F.shiftrightunsigned("_at", PARTITION_BITS))
    per = cut.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("_range", (before + 1 - F.col("_first")).alias("_shift"))
    return cut.join(starts, "_range").withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def running_sums(df: DataFrame, column: str, sums: dict[str, Column]) -> DataFrame:
    """Running totals in the order of a whole-number column, itself included."""
    ranged = add_totals_before(value_range(df, column, range_count(df)), sums)
    w = Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(w) + F.col(f"_before_{name}"))
    return out.drop("_range", *[f"_before_{n}" for n in sums])


def first_per_group(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column | str], n: int = 1, salts: int = 16
) -> DataFrame:
    """The first n rows of every group, with ``_rn`` as 1-based rank.

    Two rounds: n survivors per (group, salt), then n per group, so that a group holding
    a large share of all rows is cut down in many tasks before it meets in one.
    """
    named = {f"_k{i}": (F.col(k) if isinstance(k, str) else k) for i, k in enumerate(keys)}
    wide = df.withColumns(named)
    if n > 1:
        salted = wide.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
        w1 = Window.partitionBy(*named, "_salt").orderBy(*order)
        wide = salted.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    w2 = Window.partitionBy(*named).orderBy(*order)
    return wide.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n).drop(*named)


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, picks: dict[str, tuple[float, str]]
) -> DataFrame:
    """Exact order statistics per group.

    picks: name -> (q, rule). Rules over n sorted values:
      linear  interpolation at position q * (n - 1)
      lower   the value at int(q * (n - 1))
      upper   the value at int(n * q)
    A quantile sketch brackets each position; only the rows inside the bracket are ordered. What
    lies outside is merely counted, with its value next to the bracket: in a small group, where
    the sketch is exact, a position can miss the bracket by one row.
    """
    names, slack = list(picks), 2.0 / ACCURACY
    points = [p for q, _ in picks.values() for p in (max(0.0, q - slack), min(1.0, q + slack))]
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if not by:
        data = data.withColumn("_all", F.lit(0))
    keys = list(by) or ["_all"]
    brackets = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(p) for p in points]), ACCURACY).alias("_b")
    )
    v = F.col("_v")

    def entry(i: int) -> Column:
        side = F.when(v < F.col("_b")[2 * i], -1).when(v > F.col("_b")[2 * i + 1], 1).otherwise(0)
        return F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 0, v).alias("v"))

    tallies = (
        data.join(brackets, keys)
        .select(*keys, "_n", "_v", F.explode(F.array(*[entry(i) for i in range(len(names))])).alias("e"))
        .groupBy(*keys, "_n", F.col("e.i").alias("_i"), F.col("e.side").alias("_side"), F.col("e.v").alias("_at"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    )
    w = Window.partitionBy(*keys, "_i").orderBy("_side", "_at")
    ranked = tallies.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    aggs = [F.max("_n").alias("n")]

    def found(here: Column, position: Column) -> Column:
        inside = (F.col("_from") <= position) & (position < F.col("_to"))
        side = F.col("_side")
        at = F.when(side == 0, F.col("_at")).when((side < 0) & (position == F.col("_to") - 1), F.col("_most")).when((side > 0) & (position == F.col("_from")), F.col("_least"))
        return F.max(F.when(here & inside, at))

    for i, name in enumerate(names):
        q, rule = picks[name]
        n = F.col("_n")
        at = (n - 1) * F.lit(q) if rule != "upper" else n * F.lit(q)
        below = F.floor(at)
        above = F.ceil(at) if rule == "linear" else below
        here = F.col("_i") == i
        v_lo, v_hi = found(here, below), found(here, above)
        share = F.max(F.when(here, at - below))
        if rule == "linear":
            aggs.append(F.when(share == 0, v_lo).otherwise(v_lo * (1 - share) + v_hi * share).alias(name))
        else:
            aggs.append(v_lo.alias(name))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out if by else out.drop("_all")


def preceding_rows(
    df: DataFrame, keys: Sequence[str], order: str, payload: Column, n: int, out: str, chunk: int = 4096
) -> DataFrame:
    """The n rows before each row of its sequence, oldest first, as an array.

    A sequence is cut into chunks of its whole-number order, so that one very long
    sequence is spread over many tasks; a chunk gets the tail of what came before it.
    """
    cut = df.withColumn("_item", payload).withColumn("_chunk", F.floor(F.col(order) / chunk))
    tail = cut.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct(F.col(order), "_item"))).alias("_t"))
    tail = tail.withColumn("_t", F.transform(F.slice("_t", F.greatest(F.lit(1), F.size("_t") - n + 1), n), lambda x: x["_item"]))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-n, -1)
    carry = tail.select(*keys, "_chunk", F.flatten(F.collect_list("_t").over(before)).alias("_carry"))
    near = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(-n, -1)
    local = cut.withColumn("_near", F.collect_list("_item").over(near)).join(carry, [*keys, "_chunk"])
    both = F.concat("_carry", "_near")
    last = F.slice(both, F.greatest(F.lit(1), F.size(both) - n + 1), n)
    return local.withColumn(out, last).drop("_item", "_chunk", "_near", "_carry")
