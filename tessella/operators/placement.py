"""Where things and players go: rings of places around a point, profiles along roads, planes of degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directions, rings and step of the search for a start; those of an arrival; its most rise; edge codes.
START = (((1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)), 29, 96)
ARRIVAL, ARRIVAL_RISE = (tuple((math.cos(math.radians(45 * k)), math.sin(math.radians(45 * k))) for k in range(8)), 8, 64), 160
EDGES = {"W": 1, "E": 2, "S": 3, "N": 4}
#: Fixed value: added to a height that is handed over, as -1 means none.
HEIGHT_BIAS = 65536


def spiral(points: DataFrame, search: tuple = START) -> DataFrame:
    """Places to_x, to_y to try around each point (x, y): itself (try 0), then each direction of the nearest ring, and so on."""
    directions, rings, step = search
    ways = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in directions])
    tried = points.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(rings * len(directions))).cast("array<long>")))
    ring = F.when(F.col("try") > 0, F.floor((F.col("try") - 1) / len(directions)) + 1).otherwise(0)
    way = F.element_at(ways, (F.pmod(F.col("try") - 1, F.lit(len(directions))) + 1).cast("int"))
    return tried.withColumns({"to_x": F.col("x") + ring * step * way["x"], "to_y": F.col("y") + ring * step * way["y"]})


def first_clear(tries: DataFrame, key: str, clear: Column) -> DataFrame:
    """The first place of each point that is clear; points without one are left out."""
    return tries.where(clear).groupBy(key).agg(F.min(F.struct("try", "to_x", "to_y")).alias("t")).select(key, "t.*")


def arrival(floor: Column, departure: Column) -> Column:
    """A floor that a player may arrive on."""
    return F.abs(floor - departure) <= ARRIVAL_RISE


def hand_over(direction: Column, z: Column) -> Column:
    """Direction code and height as one number; null where there is no hand-over."""
    code = F.create_map(*[F.lit(x) for pair in EDGES.items() for x in pair])
    return F.try_element_at(code, F.coalesce(direction, F.lit(""))).cast("long") * (2 * HEIGHT_BIAS) + z + HEIGHT_BIAS


def handed_over(value: Column) -> tuple[Column, Column]:
    """Direction and height of hand_over."""
    code = F.create_map(*[F.lit(x) for k, v in EDGES.items() for x in (v, k)])
    return F.try_element_at(code, F.floor(value / (2 * HEIGHT_BIAS)).cast("int")), F.pmod(value, F.lit(2 * HEIGHT_BIAS)) - HEIGHT_BIAS


def samples(lines: DataFrame, step: float, key: str = "way_id") -> DataFrame:
    """Equally spaced points along each line: at least two, one a step. lines: key, points (array of x, y), length."""
    spans = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.hypot(F.element_at("points", i + 1)["x"] - F.element_at("points", i)["x"], F.element_at("points", i + 1)["y"] - F.element_at("points", i)["y"]))
    lines = lines.where(F.size("points") >= 2).withColumn("_s", spans)
    lines = lines.withColumn("length", F.aggregate("_s", F.lit(0.0), lambda a, s: a + s))
    reach = F.transform(F.sequence(F.lit(0), F.size("_s")), lambda i: F.aggregate(F.slice("_s", F.lit(1), i), F.lit(0.0), lambda a, s: a + s))
    lines = lines.withColumn("_r", reach).withColumn("n", F.greatest(F.lit(2), F.floor(F.col("length") / step).cast("int") + 1))
    rows = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("at", F.col("length") * F.col("i") / (F.col("n") - 1))
    k = F.greatest(F.lit(1), F.least(F.size("_s"), F.size(F.filter("_r", lambda r: r <= F.col("at")))))
    rows = rows.withColumn("_k", k).withColumn("_t", F.coalesce((F.col("at") - F.element_at("_r", F.col("_k"))) / F.nullif(F.element_at("_s", F.col("_k")), F.lit(0.0)), F.lit(0.0)))
    along = lambda c: F.element_at("points", F.col("_k"))[c] + F.col("_t") * (F.element_at("points", F.col("_k") + 1)[c] - F.element_at("points", F.col("_k"))[c])
    return rows.select(key, F.col("i").cast("long").alias("i"), "at", along("x").alias("x"), along("y").alias("y"))


def deck(heights: Column) -> Column:
    """A bridge is level at the higher of its ends."""
    return F.greatest(F.element_at(heights, 1), F.element_at(heights, -1))


def profile_height(heights: Column, share: Column, ground: Column, limit: float) -> Column:
    """The profile's height at a share (0 to 1) of its length, held within limit of the ground."""
    n = F.size(heights)
    place = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (n - 1)
    low = F.greatest(F.lit(0), F.least(n - 2, F.floor(place).cast("int")))
    a, b = F.element_at(heights, low + 1), F.element_at(heights, F.least(low + 2, n))
    return F.greatest(ground - limit, F.least(ground + limit, a + (place - low) * (b - a)))


def degree_plane(v0: Column, v_east: Column, v_north: Column, size: int, units: int = 32) -> dict[str, Column]:
    """A value's linear form over a tile's units, from its values at three corners."""
    return {"at0": v0, "per_x": (v_east - v0) / size / units, "per_y": (v_north - v0) / size / units}


def diagnose(points: DataFrame, things: DataFrame, lines: DataFrame, radius: float, reach: float, step: float, cell: int) -> DataFrame:
    """pt_id, blocking things within radius and impassable lines within reach; zero where nothing blocks.

    things: x, y; lines: x1, y1, x2, y2, blocking, rise (null: one-sided).
    """
    far = max(radius, reach)
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    p = points.select("pt_id", "px", "py").withColumn("cx", F.explode(span(F.col("px") - far, F.col("px") + far))).withColumn("cy", F.explode(span(F.col("py") - far, F.col("py") + far)))
    t = things.select("x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    solid = p.join(t, ["cx", "cy"]).where((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2 < radius * radius).groupBy("pt_id").agg(F.count("*").alias("things"))
    # A line is met in one cell only: the first that it and the point's square both cover.
    ends = lambda c: (F.least(f"{c}1", f"{c}2"), F.greatest(f"{c}1", f"{c}2"))
    hard = lines.where(F.col("rise").isNull() | (F.col("rise") > step) | F.col("blocking"))
    placed = hard.withColumn("cx", F.explode(span(*ends("x")))).withColumn("cy", F.explode(span(*ends("y"))))
    first = lambda c: F.greatest(F.floor(ends(c)[0] / cell), F.floor((F.col(f"p{c}") - far) / cell)) == F.col(f"c{c}")
    met = p.join(placed, ["cx", "cy"]).where(first("x") & first("y"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t_ = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / F.nullif((dx * dx + dy * dy).cast("double"), F.lit(0.0)))), F.lit(0.0))
    met = met.withColumn("_t", t_).where((F.col("px") - F.col("x1") - F.col("_t") * dx) ** 2 + (F.col("py") - F.col("y1") - F.col("_t") * dy) ** 2 <= reach * reach)
    lines_ = met.groupBy("pt_id").agg(F.count("*").alias("lines"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return points.select("pt_id").join(solid, "pt_id", "left").join(lines_, "pt_id", "left").select("pt_id", zero("things"), zero("lines"))
