"""Connected components over an edge table, without the driver or any single task seeing the graph.

Alternating large-star and small-star passes (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Minima are pre-aggregated on the map side, and a hub's rows sit on the splittable side of a
sort-merge join, so that a component with a third of all nodes is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscale.llm.runtime import materialize


def components(edges: DataFrame, label: str = "components", most: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, the component being its smallest node.

    Nodes are those that some edge names; self-loops count as nodes. No edges: an empty frame.
    """
    nodes = materialize(
        edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct().select("a", "b"),
        f"{label}-edges",
    )
    now = nodes.where("a != b")
    seen = None
    for _ in range(most):
        now = materialize(_small_star(_large_star(now)), f"{label}-star")
        state = now.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s"),
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} passes")
    own = nodes.select(F.explode(F.array("a", "b")).alias("node"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return (
        own.select("node", F.col("node").alias("component"))
        .unionByName(found)
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a != b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
