"""Indexed scans and spatial joins, blocked by cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators import tally


def _covering(df: DataFrame, cell: int, west="west", south="south", east="east", north="north") -> DataFrame:
    """One row a cell that the box touches, inclusive at both ends."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return df.withColumn("cx", span(west, east)).withColumn("cy", span(south, north))


def boxes_of(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.groupBy(key).agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"), F.count("*").alias("points"))


def candidates(queries: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """(query_id, way_id) whose boxes overlap (closed): equal cells first, then the boxes."""
    q = _covering(queries, cell, "q_west", "q_south", "q_east", "q_north")
    joined = q.join(_covering(boxes, cell), ["cx", "cy"])
    hit = joined.where("west <= q_east AND east >= q_west AND south <= q_north AND north >= q_south")
    # Each pair in one cell only: the first that both cover. No second shuffle for a distinct.
    first = lambda a, b: F.greatest(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    hit = hit.where((F.col("cx") == first("west", "q_west")) & (F.col("cy") == first("south", "q_south")))
    return hit.select("query_id", "way_id", "q_west", "q_south", "q_east", "q_north")


def linework(queries: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """(query_id, way_id) where a segment meets the query's box; a way that only surrounds it does not count."""
    boxes = segments.select("way_id", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("west"), F.least("y1", "y2").alias("south"), F.greatest("x1", "x2").alias("east"), F.greatest("y1", "y2").alias("north"))
    joined = _covering(queries, cell, "q_west", "q_south", "q_east", "q_north").join(_covering(boxes, cell), ["cx", "cy"])
    meets = g.segment_meets_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "q_west", "q_south", "q_east", "q_north")])
    return joined.where(meets).select("query_id", "way_id").distinct()


def _by_place(rows: DataFrame, key: str, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """key, the place and how often it comes (_n) of keys with one place, and the rows of the other keys."""
    own = rows.where(f"{key} IS NOT NULL").groupBy(key).agg(F.count("*").alias("_n"), F.collect_set(F.struct(*place)).alias("_at"))
    one = own.where("size(_at) = 1").select(key, "_n", F.col("_at")[0].alias("_p")).select(key, "_n", "_p.*")
    return one, rows.join(own.where("size(_at) > 1").select(key), key, "left_semi")


def candidate_counts(queries: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """query_id, ways and id_sum of candidates(), without its pairs where no box of a query ends before it begins."""
    place = ["q_west", "q_south", "q_east", "q_north"]
    fair = "q_west <= q_east AND q_south <= q_north"
    right = queries.where(fair)
    told = right.join(tally.boxes_at_boxes(right, boxes), place).select("query_id", F.col("s0").alias("ways"), "id_sum")
    plain = candidates(queries.where(f"NOT ({fair})"), boxes, cell).groupBy("query_id").agg(F.count("*").alias("ways"), F.sum("way_id").alias("id_sum"))
    return told.unionByName(plain).groupBy("query_id").agg(F.sum("ways").alias("ways"), F.sum("id_sum").alias("id_sum"))


def linework_counts(queries: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """query_id and ways: how many linework() finds, without its pairs; queries of more than one box go through it."""
    place = ["q_west", "q_south", "q_east", "q_north"]
    one, rest = _by_place(queries, "query_id", place)
    told = one.join(tally.lines_at_boxes(one, segments, cell), place).select("query_id", F.col("s0").alias("ways"))
    return told.unionByName(linework(rest, segments, cell).groupBy("query_id").agg(F.count("*").alias("ways")))


def inside_counts(points: DataFrame, rings: DataFrame, cell: int) -> DataFrame:
    """pt_id, rings and id_sum: how many inside() finds, and the sum of their ids, without its pairs.

    Points of more than one place go through it; a point that comes an even number of times has no odd crossings.
    """
    one, rest = _by_place(points, "pt_id", ["px", "py"])
    told = one.where("_n % 2 = 1").join(tally.rings_at_points(one, rings, 2 * cell), ["px", "py"]).select("pt_id", F.col("s0").alias("rings"), "id_sum")
    return told.unionByName(inside(rest, rings, cell).groupBy("pt_id").agg(F.count("*").alias("rings"), F.sum("way_id").alias("id_sum")))


def inside(points: DataFrame, rings: DataFrame, cell: int) -> DataFrame:
    """(pt_id, way_id) of points inside closed rings (edges way_id, x1, y1, x2, y2), by the parity of ray crossings.

    Edges meet points in the bands of rows that the edge spans, so no ring is held as a whole.
    """
    bands = rings.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    placed = points.withColumn("band", F.floor(F.col("py") / cell))
    hit = placed.join(bands, "band").where(g.crosses_ray(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "px", "py")]))
    return hit.groupBy("pt_id", "way_id").count().where("count % 2 = 1").select("pt_id", "way_id")


def nearest(points: DataFrame, places: DataFrame, limit: int) -> DataFrame:
    """pt_id, place_id (null if none) and squared distance of the nearest place within limit; ties to the smaller id."""
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    p = points.withColumn("dx", around).withColumn("dy", around)
    p = p.select("pt_id", "px", "py", (F.floor(F.col("px") / limit) + F.col("dx")).alias("cx"), (F.floor(F.col("py") / limit) + F.col("dy")).alias("cy"))
    q = places.select("place_id", "qx", "qy", F.floor(F.col("qx") / limit).alias("cx"), F.floor(F.col("qy") / limit).alias("cy"))
    d = (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy"))
    best = p.join(q, ["cx", "cy"]).withColumn("d2", d).where(F.col("d2") <= limit * limit).groupBy("pt_id").agg(F.min(F.struct("d2", "place_id")).alias("best"))
    return points.select("pt_id").join(best, "pt_id", "left").select("pt_id", F.col("best.place_id").alias("place_id"), F.col("best.d2").alias("d2"))


def side_of_line(points: DataFrame, segments: DataFrame, limit: int) -> DataFrame:
    """pt_id, way_id and side (1 left, -1 right, 0 on it) of the line's segment that is nearest within limit; ties to the smaller way, then the earlier segment.

    points: pt_id, px, py; segments: way_id, seq, x1, y1, x2, y2. Distances are to segments. Each task tells which of its segments may be nearest to a point; the rest is the same for all.
    """
    c = F.col
    met = tally.near_segments(points, segments, limit, 800)
    dx, dy = (c("x2") - c("x1")).cast("double"), (c("y2") - c("y1")).cast("double")
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("px") - c("x1")) * dx + (c("py") - c("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    met = met.withColumn("_t", t)
    d2 = F.pow(c("px") - c("x1") - c("_t") * dx, F.lit(2)) + F.pow(c("py") - c("y1") - c("_t") * dy, F.lit(2))
    met = met.withColumns({"_d": F.round(d2, 6), "_s": F.signum(g.cross(c("x1"), c("y1"), c("x2"), c("y2"), c("px"), c("py")).cast("double")).cast("int")}).where(d2 <= limit * limit)
    best = met.groupBy("px", "py").agg(F.min(F.struct("_d", "way_id", "seq", "_s")).alias("b"))
    best = points.join(best, ["px", "py"]).groupBy("pt_id").agg(F.min("b").alias("b"))
    return best.select("pt_id", c("b.way_id").alias("way_id"), c("b._s").alias("side"))


def squares_of(rings: DataFrame, cell: int, key: str) -> DataFrame:
    """key, cx, cy of every square that a polygon meets: one that its edges cross, or one inside it. rings: way_id, x1, y1, x2, y2 (key is way_id)."""
    lines = rings.select("way_id", F.least("x1", "x2").alias("west"), F.least("y1", "y2").alias("south"), F.greatest("x1", "x2").alias("east"), F.greatest("y1", "y2").alias("north"), "x1", "y1", "x2", "y2")
    spread = _covering(lines, cell)
    at = lambda c, k=0: (F.col(c) + k) * cell
    crossed = spread.where(g.segment_meets_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], at("cx"), at("cy"), at("cx", 1), at("cy", 1))).select("way_id", "cx", "cy").distinct()
    # A square that no edge meets is inside if its corner is: runs of such squares lie between crossings of its row.
    row = rings.where("y1 <> y2").withColumn("cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.ceil(F.greatest("y1", "y2") / cell))))
    y = F.col("cy") * cell
    row = row.where((y >= F.least("y1", "y2")) & (y < F.greatest("y1", "y2"))).withColumn("cut", F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    nth = F.row_number().over(W.partitionBy("way_id", "cy").orderBy("cut"))
    spans = row.withColumn("pair", F.floor((nth - 1) / 2)).groupBy("way_id", "cy", "pair").agg(F.min("cut").alias("a"), F.max("cut").alias("b"))
    inner = spans.withColumn("cx", F.explode(F.sequence(F.ceil(F.col("a") / cell), F.floor(F.col("b") / cell)))).where((F.col("cx") * cell >= F.col("a")) & (F.col("cx") * cell < F.col("b"))).select("way_id", "cx", "cy")
    return crossed.unionByName(inner).distinct().select(F.col("way_id").alias(key), "cx", "cy")
