"""Operators on ordered points and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(nodes: DataFrame, key: str = "way_id", order: str = "seq") -> DataFrame:
    """Consecutive pairs of points."""
    w = W.partitionBy(key).orderBy(order)
    return nodes.select(key, order, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")


def rings(nodes: DataFrame, key: str = "way_id", order: str = "seq") -> DataFrame:
    """Consecutive pairs, the last joined to the first; under four points there is no ring."""
    w = W.partitionBy(key)
    line = w.orderBy(order)
    to = lambda c: F.coalesce(F.lead(c).over(line), F.first(c).over(line)).alias(f"{c}2")
    pairs = nodes.select(key, order, F.col("x").alias("x1"), F.col("y").alias("y1"), to("x"), to("y"), F.count("*").over(w).alias("points"))
    return pairs.where("points >= 4").drop("points")


def areas(edges: DataFrame, key: str = "way_id") -> DataFrame:
    """Twice the signed area of each ring."""
    return edges.groupBy(key).agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("area2"))


def without_repeats(nodes: DataFrame, key: str = "way_id", order: str = "seq") -> DataFrame:
    """Points that differ from the one before; ways with fewer than two left are dropped."""
    line = W.partitionBy(key).orderBy(order)
    same = (F.lag("x").over(line) == F.col("x")) & (F.lag("y").over(line) == F.col("y"))
    kept = nodes.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same")
    return kept.withColumn("_n", F.count("*").over(W.partitionBy(key))).where("_n >= 2").drop("_n")


def straighten(values: DataFrame, radius: int, key: str, order: str, value: str) -> DataFrame:
    """Local straight-line fit through a window that is cut short at the ends; a lone point keeps its value."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-radius, radius)
    fit = F.regr_intercept(value, order).over(w) + F.regr_slope(value, order).over(w) * F.col(order)
    return values.withColumn("fitted", F.coalesce(fit, F.col(value).cast("double")))


def last_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key: maxima combine before the shuffle, unlike a window's sort."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])
