"""Iterative operators on adjacency: each round is one join, cut by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.shared import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def reach(edges: DataFrame, start: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that undirected edges (a, b) lead to from start; only the newest nodes join in each round."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    seen = cut(start.select(F.col(node).alias("n")).distinct())
    newest = seen
    while True:
        found = both.join(newest.withColumnRenamed("n", "a"), "a").select(F.col("b").alias("n")).distinct()
        newest = cut(found.join(seen, "n", "left_anti"))
        if newest.isEmpty():
            return seen.withColumnRenamed("n", node)
        seen = cut(seen.unionByName(newest))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node and the least node of its component, by repeated minima with pointer jumping."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = cut(nodes.select(F.col(node).alias("n"), F.col(node).alias("l")).distinct())
    while True:
        near = both.join(state.withColumnRenamed("n", "b"), "b").groupBy(F.col("a").alias("n")).agg(F.min("l").alias("m"))
        hooked = state.join(near, "n", "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        jump = hooked.groupBy("l").agg(F.min("m").alias("j"))
        step = cut(hooked.join(jump, "l").select("n", F.least("m", "j").alias("l"), (F.least("m", "j") < F.col("l")).alias("moved")))
        state = step.select("n", "l")
        if step.where("moved").isEmpty():
            return state.select(F.col("n").alias(node), F.col("l").alias("component"))
