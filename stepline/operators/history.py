"""What was done before a step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepline.functions.actions import HISTORY_STEPS, last_items
from stepline.operators.ordering import preceding_rows


def history_before(df: DataFrame, keys: Sequence[str], order: str, entry: str, n: int = HISTORY_STEPS) -> DataFrame:
    """Both readings of 'the last n actions' before each step.

    raw_first    the n preceding rows, of which the parsable ones count
    parse_first  the n last parsable rows
    The second is the first over the parsable rows alone; a step finds the entries up to it
    by the number of parsable rows before it in its sequence.
    """
    raw = preceding_rows(df, keys, order, F.struct(F.col(entry).alias("e")), n, "_raw")
    raw = raw.withColumn("raw_first", F.transform(F.filter("_raw", lambda x: x["e"].isNotNull()), lambda x: x["e"])).drop("_raw")
    return _parse_first(raw, keys, order, entry, n)


def _parse_first(df: DataFrame, keys: Sequence[str], order: str, entry: str, n: int, chunk: int = 4096) -> DataFrame:
    """The n last parsable entries, with long sequences cut into chunks.

    Each row is numbered by the parsable rows before it; a frame of n numbers back holds
    exactly the wanted entries, whatever lies between them.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    place = F.when(F.col(entry).isNotNull(), F.struct(F.col(order).alias("o"), F.col(entry).alias("e")))
    tails = cut.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(place)).alias("_t"))
    tails = tails.withColumn("_t", F.when(F.size("_t") > 0, F.transform(last_items(F.col("_t"), n), lambda x: x["e"])))
    ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy("_no").rangeBetween(-n, -1)
    carry = tails.withColumn("_no", F.count("_t").over(ahead)).select(
        *keys, "_chunk", F.flatten(F.collect_list("_t").over(back)).alias("_carry")
    )
    ahead_in = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    back_in = Window.partitionBy(*keys, "_chunk").orderBy("_no").rangeBetween(-n, -1)
    local = cut.withColumn("_no", F.count(entry).over(ahead_in)).withColumn("_near", F.collect_list(entry).over(back_in))
    joined = local.join(carry, [*keys, "_chunk"])
    return joined.withColumn("parse_first", last_items(F.concat("_carry", "_near"), n)).drop("_chunk", "_no", "_near", "_carry")
