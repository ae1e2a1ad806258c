"""Subtree sums of a forest by centroid decomposition.

Nodes carry a weight for everything at or below them. The centroid of a component is its lowest
node with more than half of the component's weight; the nodes with more than half are exactly
the path from the centroid to the component's top. What hangs off that path are components of
half the weight at most, so splitting ends after log2(weight) rounds, however deep or wide the
forest is. Sums come back the other way round: the totals of the components that hang off a
path are added to its nodes, and sums run along the path from the centroid to the top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepline.llm.scratch import Scratch

CHUNK = 4096  # nodes of a path that one window holds


def split(paths: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(chain, depth, level, top_chain, top_depth) of every node, and the number of levels.

    ``paths`` has (chain, depth, weight, owner): for every chain its nodes from a root down; a
    node is named by the chain that owns it and its depth, and weights fall along a chain. All
    components of a level are split at once: the first node of a chain that is not placed yet is
    the top of its next component.
    """
    left, level, levels = paths, 0, []
    while True:
        tops = left.groupBy("chain").agg(F.min(F.struct("depth", "owner", "weight")).alias("top"))
        told = left.join(tops, "chain").select("chain", "depth", "weight", "owner", F.col("top.owner").alias("top_chain"), F.col("top.depth").alias("top_depth"), (2 * F.col("weight") > F.col("top.weight")).alias("on_path"))
        now = scratch.keep(told, f"level{level}")
        if now.isEmpty():
            break
        levels.append(now.where("on_path and chain = owner").select("chain", "depth", F.lit(level).alias("level"), "top_chain", "top_depth"))
        left = now.where("not on_path").select("chain", "depth", "weight", "owner")
        level += 1
    placed = levels[0] if levels else now.select("chain", "depth", F.lit(0).alias("level"), "top_chain", "top_depth")
    for more in levels[1:]:
        placed = placed.union(more)
    return placed, level


def _along_path(nodes: DataFrame, values: list[str]) -> DataFrame:
    """values summed from the end of each path up to the node; long paths are cut into chunks."""
    top = ["top_chain", "top_depth"]
    cut = nodes.withColumn("chunk", F.floor((F.col("depth") - F.col("top_depth")) / CHUNK))
    later = Window.partitionBy(*top).orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy(*top, "chunk").agg(*[F.sum(v).alias(v) for v in values])
    after = per.select(*top, "chunk", *[F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"after_{v}") for v in values])
    up = Window.partitionBy(*top, "chunk").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(after, [*top, "chunk"])
    return joined.withColumns({v: F.sum(v).over(up) + F.col(f"after_{v}") for v in values}).drop("chunk", *[f"after_{v}" for v in values])


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """(chain, depth, values) with every value summed over the node's subtree, the node included.

    ``nodes`` has one row per node: (chain, depth, parent_chain) and the values, long; the parent
    is one less deep. ``paths`` is that of ``split``. No nodes give no rows.
    """
    places, levels = split(paths, scratch)
    known = scratch.keep(nodes.join(places, ["chain", "depth"]), "placed")
    out, hanging = [], None
    for level in range(levels - 1, -1, -1):
        here = known.where(F.col("level") == level)
        if hanging is not None:
            under = hanging.groupBy("parent_chain", "depth").agg(*[F.sum(v).alias(f"under_{v}") for v in values])
            under = under.select(F.col("parent_chain").alias("chain"), (F.col("depth") - 1).alias("depth"), *[f"under_{v}" for v in values])
            here = here.join(under, ["chain", "depth"], "left")
            here = here.withColumns({v: F.col(v) + F.coalesce(f"under_{v}", F.lit(0)) for v in values}).drop(*[f"under_{v}" for v in values])
        done = scratch.keep(_along_path(here, values), f"sums{level}")
        hanging = done.where("chain = top_chain and depth = top_depth")
        out.append(done.select("chain", "depth", *values))
    whole = out[0] if out else known.select("chain", "depth", *values)
    for more in out[1:]:
        whole = whole.union(more)
    return whole
