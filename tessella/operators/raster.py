"""Operators on rasters in long form: one row a cell, missing cells are holes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame_of(tiles: DataFrame, rows: int, cols: int, tile: str = "tile_no") -> DataFrame:
    """Every cell of every tile."""
    return tiles.select(tile).distinct().withColumn("prow", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))).withColumn("pcol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))


def zonal(cells: DataFrame, rows: int, cols: int, tile: str = "tile_no") -> DataFrame:
    """Median ground, 90th percentile of surface above ground (linear), and share of cells with data."""
    return cells.groupBy(tile).agg(F.median("dtm").alias("median_dtm"), F.percentile(F.col("dsm") - F.col("dtm"), F.lit(0.9)).alias("p90_height"), (F.count("dtm") / F.lit(rows * cols)).alias("coverage"))


def fill_holes(cells: DataFrame, rows: int, cols: int, value: str = "dtm", tile: str = "tile_no") -> DataFrame:
    """All cells; holes take their tile's median. Medians are one row a tile, so no tile is sorted in one task twice."""
    medians = cells.groupBy(tile).agg(F.median(value).alias("_median"))
    grid = frame_of(cells, rows, cols, tile).join(cells.select(tile, "prow", "pcol", value), [tile, "prow", "pcol"], "left")
    return grid.join(medians, tile).select(tile, "prow", "pcol", F.coalesce(value, "_median").alias("z"))


def _blur(cells: DataFrame, radius: int, across: str, along: str, tile: str) -> DataFrame:
    line = W.partitionBy(tile, along).orderBy(across)
    near, whole = line.rowsBetween(-radius, radius), line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, i = F.count("*").over(whole), F.row_number().over(line) - 1
    before, after = F.greatest(F.lit(0), F.lit(radius) - i), F.greatest(F.lit(0), i + radius - (n - 1))
    total = F.sum("z").over(near) + before * F.first("z").over(whole) + after * F.last("z").over(whole)
    return cells.withColumn("z", total / F.lit(2 * radius + 1))


def smooth(cells: DataFrame, radius: int, passes: int = 2, tile: str = "tile_no") -> DataFrame:
    """Box blur along both axes, edges repeated outwards."""
    for _ in range(passes):
        cells = _blur(_blur(cells, radius, "prow", "pcol", tile), radius, "pcol", "prow", tile)
    return cells


def bands(cells: DataFrame, step: float, value: str = "z") -> DataFrame:
    """Height bands from the datum, so that neighbouring tiles agree."""
    return cells.withColumn("band", F.floor(F.col(value) / F.lit(float(step))).cast("long"))


def window(cells: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Lowest, highest and mean ground of the part of its tile that each box covers (closed at both ends).

    boxes: key, tile_no, row0, row1, col0, col1.
    """
    hit = boxes.join(cells, "tile_no").where("prow BETWEEN row0 AND row1 AND pcol BETWEEN col0 AND col1")
    return hit.groupBy(key).agg(F.min("dtm").alias("low"), F.max("dtm").alias("high"), F.avg("dtm").alias("mean"), F.count("dtm").alias("cells"))


def under(cells: DataFrame, footprints: DataFrame, rings: DataFrame, key: str = "way_id") -> DataFrame:
    """Median ground under each footprint: the cells whose centres lie inside; the tile's median where there is none.

    footprints: key, tile_no; rings: key, tile_no, x1, y1, x2, y2 in cells, x along a row.
    """
    # Centres are halves, so all is doubled: an edge crosses the rows between its ends.
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossed = rings.where("y1 <> y2").withColumn("prow", F.explode(F.sequence(F.floor(low).cast("long"), F.ceil(high).cast("long"))))
    y = F.col("prow") + 0.5
    crossed = crossed.where((y >= low) & (y < high)).withColumn("cut", F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    nth = F.row_number().over(W.partitionBy(key, "prow").orderBy("cut"))
    spans = crossed.withColumn("pair", F.floor((nth - 1) / 2)).groupBy(key, "tile_no", "prow", "pair").agg(F.min("cut").alias("a"), F.max("cut").alias("b"))
    inside = spans.join(cells, ["tile_no", "prow"]).where((F.col("pcol") + 0.5 >= F.col("a")) & (F.col("pcol") + 0.5 < F.col("b")))
    own = inside.groupBy(key).agg(F.median("dtm").alias("own"))
    whole = cells.groupBy("tile_no").agg(F.median("dtm").alias("whole"))
    return footprints.join(own, key, "left").join(whole, "tile_no", "left").select(key, F.coalesce("own", "whole").alias("median_dtm"))


def elevations(bands: DataFrame, by: str, value: str) -> DataFrame:
    """First, last and middle (n div 2) of the distinct band elevations."""
    counted = bands.select(by, value).distinct().withColumns({"_i": F.row_number().over(W.partitionBy(by).orderBy(value)) - 1, "_n": F.count("*").over(W.partitionBy(by))})
    return counted.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col(value))).alias("base"))
