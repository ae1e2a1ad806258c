"""Connected components of an edge table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.union(least.select("m", "hi")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from the centre of a star to a node with no other edge."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up")).union(edges.select("lo", F.lit(0)))
    held = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("centre"))
    return held.agg(F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("centre") == 0)))).first()[0] is not True


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Rounds of large and small stars until all edges are stars of their smallest nodes; each round
    is written, so the plan stays flat. Hubs are minima (combined before the shuffle) and joins Spark can split. Self
    loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    start = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, step = scratch.keep(start.distinct(), f"{name}0"), 0
    while not _settled(now):
        step += 1
        now = scratch.keep(_small_star(_large_star(now)), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
