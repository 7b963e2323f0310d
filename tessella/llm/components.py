"""Connected components by repeated minimum labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import Scratch, written


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", label: str = "label", a: str = "a", b: str = "b", roots: bool = False) -> DataFrame:
    """Rows of nodes (node, label) with label lowered to the least label in the node's component; with roots, also root, its least node.

    Nodes are distinct and not null. The loop runs on the nodes themselves, as labels may be null or repeat; a component
    has a null label only if all its labels are null. Edges are undirected, may repeat, and name only nodes that exist.
    Minima combine before each shuffle, so a hub with many edges sends one row a task.
    """
    with Scratch(nodes.sparkSession) as scratch:
        both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        both = scratch.written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
        step = scratch.written(both.select(F.col("u").alias("n"), F.col("u").alias("l")).distinct(), "labels")
        while True:
            state = step.select("n", "l")
            near = both.join(state.withColumnRenamed("n", "v"), "v").groupBy(F.col("u").alias("n")).agg(F.min("l").alias("m"))
            hooked = state.join(near, "n").select("n", "l", F.least("l", "m").alias("m"))
            # A label that is now known to be joined to a lower one passes that on to all who carry it.
            jump = hooked.groupBy("l").agg(F.min("m").alias("j"))
            last, step = step, scratch.written(hooked.join(jump, "l").select("n", F.least("m", "j").alias("l"), (F.least("m", "j") < F.col("l")).alias("moved")), "labels")
            scratch.drop(last)
            if step.where("moved").isEmpty():
                break
        state = step.select("n", "l")
        least = state.join(nodes.select(F.col(node).alias("n"), F.col(label).alias("m")), "n").groupBy("l").agg(F.min("m").alias("m"))
        lowered = written(state.join(least, "l").select(F.col("n").alias("_node"), F.col("m").alias("_least"), F.col("l").alias("_root")), "components")
    joined = nodes.select(F.col(node).alias("_node"), F.col(label).alias("_label")).join(lowered, "_node", "left")
    root = [F.coalesce("_root", "_node").alias("root")] if roots else []
    return joined.select(F.col("_node").alias(node), F.coalesce("_least", "_label").alias(label), *root)
