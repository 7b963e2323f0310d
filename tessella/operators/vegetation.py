"""Patches of canopy in a raster, and trees scattered over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Least and greatest height of canopy, least area of a patch, area a tree (metres), and trees a tile.
CANOPY, PATCH_M2, TREE_M2, TREES = (3.0, 28.0), 6.0, 45.0, 900


def label(rows: np.ndarray, cols: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each cell the least index of the cells that it joins through equal neighbours to the four sides."""
    root = np.arange(len(rows))
    at = {(r, c): i for i, (r, c) in enumerate(zip(rows.tolist(), cols.tolist()))}
    kinds = kind.tolist()

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for (r, c), i in at.items():
        for j in (at.get((r + 1, c)), at.get((r, c + 1))):
            if j is not None and kinds[i] == kinds[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(rows))], np.int64)


def regions(cells: DataFrame, kind: str = "band") -> DataFrame:
    """cells (tile_no, prow, pcol, kind, ...) with region: the number of its first cell in reading order, from 0.

    Missing cells join nothing. A tile is one unit of work, of bounded size.
    """
    cells = cells.where(F.col(kind).isNotNull())

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["prow", "pcol"])
        first = label(part["prow"].to_numpy(), part["pcol"].to_numpy(), part[kind].to_numpy())
        return part.assign(region=np.unique(first, return_inverse=True)[1].astype("int64"))

    return cells.groupBy("tile_no").applyInPandas(run, StructType([*cells.schema.fields, StructField("region", LongType())]))


def canopy(cells: DataFrame, low: float = CANOPY[0], high: float = CANOPY[1]) -> DataFrame:
    """Cells whose surface stands low to high above the ground, as canopy (1) with their height."""
    tall = F.col("dsm") - F.col("dtm")
    return cells.withColumn("tall", tall).where(F.col("tall").between(low, high)).withColumn("canopy", F.lit(1))


def patches(cells: DataFrame, blocked: DataFrame | None = None, pixel_m2: float = 1.0, least: float = PATCH_M2) -> DataFrame:
    """tile_no, region, cells, height (90th percentile) of connected canopy of at least `least` square metres.

    blocked: cells (tile_no, prow, pcol) that buildings, roads or water cover; canopy there does not count.
    """
    found = canopy(cells)
    if blocked is not None:
        found = found.join(blocked.select("tile_no", "prow", "pcol").distinct(), ["tile_no", "prow", "pcol"], "left_anti")
    placed = regions(found.select("tile_no", "prow", "pcol", F.col("tall").cast("double").alias("tall"), "canopy"), "canopy")
    sized = placed.groupBy("tile_no", "region").agg(F.count("*").alias("cells"), F.percentile("tall", F.lit(0.9)).alias("height"))
    return sized.where(F.col("cells") * pixel_m2 >= least)


def scatter(patches: DataFrame, inside, tree_m2: float = TREE_M2) -> DataFrame:
    """Trees on a jittered grid over each patch, at least one. patches: patch, area, west, south, east, north, cx, cy (a point inside).

    inside(df) keeps the rows whose x, y lie in the row's patch. The jitter hashes the patch and the place in the grid.
    """
    wanted = F.greatest(F.lit(1), F.floor(F.col("area") / tree_m2))
    sized = patches.withColumn("step", F.when(wanted > 1, F.greatest(F.lit(1.0), F.sqrt(F.col("area") / wanted))))
    count = lambda a, b: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(b) - F.col(a)) / F.col("step")).cast("int") - 1))
    grid = sized.where("step IS NOT NULL").withColumn("i", F.explode(count("west", "east"))).withColumn("j", F.explode(count("south", "north")))
    jitter = lambda k: 0.15 + 0.7 * F.pmod(F.xxhash64("patch", "i", "j", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    placed = grid.withColumns({"x": F.col("west") + (F.col("i") + jitter(1)) * F.col("step"), "y": F.col("south") + (F.col("j") + jitter(2)) * F.col("step")})
    trees = inside(placed).select("patch", "x", "y")
    lone = patches.join(trees.select("patch").distinct(), "patch", "left_anti").select("patch", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    return trees.unionByName(lone)
