"""Connected components by contraction, as DataFrame joins over the edges that are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.durable import saved, scratch


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge: component is the same for nodes that edges join, and one of them.

    Each round hooks every node to the first of its neighbours, in an order by hash, so that chains of hooks are short, and
    follows four hooks at once; then the edges are contracted, and loops and doubles vanish. Rounds go on while an edge is
    left: about as many as the logarithm of the number of nodes. Edges with a null end are dropped.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_connected(edges, a, b))


def _connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    kept = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    left = saved(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    rounds = []
    left = left.where("a != b")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node"))
        hook = both.groupBy("a").agg(F.min(order("b")).alias("up")).select("a", F.least(F.col("up"), order("a"))["node"].alias("up"))
        for _ in range(2):
            hook = saved(hook)
            further = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            hook = hook.join(further, "up").select("a", F.col("top").alias("up"))
        hook = saved(hook)
        rounds.append(hook)
        left = left.join(hook.withColumnRenamed("up", "a2"), "a").join(hook.select(F.col("a").alias("b"), F.col("up").alias("b2")), "b")
        left = saved(left.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())

    def moved(out: DataFrame, hook: DataFrame) -> DataFrame:
        return out.join(hook.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))

    return saved(reduce(moved, rounds, nodes.withColumn("component", F.col("node"))))
