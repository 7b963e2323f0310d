"""Audits over sectors and their adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each shared edge seen from both sides; edges of a sector with itself do not count."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest)
    return edges.select("a", "b", *rest).unionByName(back).where("a <> b")


def spires(sectors: DataFrame, edges: DataFrame, cell: int, least: int, crowd: int = 8) -> DataFrame:
    """Sectors that stand `least` above all neighbours, or above the upper median of the sectors in the 3 x 3 cells around them (if at least `crowd`).

    sectors: sector, x, y, height.
    """
    tops = both_ways(edges).join(sectors.select(F.col("sector").alias("b"), F.col("height").alias("other")), "b").groupBy(F.col("a").alias("sector")).agg(F.max("other").alias("top"))
    local = _crowd_medians(sectors.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)}), crowd)
    rise = F.greatest(F.col("height") - F.col("top"), F.col("height") - F.col("median"))  # null medians do not count
    return sectors.join(tops, "sector").join(local, "sector", "left").select("sector", rise.cast("long").alias("rise")).where(F.col("rise") >= least)


def _crowd_medians(placed: DataFrame, crowd: int) -> DataFrame:
    """sector, median: the upper median of the heights of other sectors in the 3 x 3 cells around it, where they are `crowd` at least.

    Heights are counted by cell, so a cell is as many rows as it has distinct heights and no pairs of sectors are made. Of the
    counts around a sector its own are taken out by rank: n of its height h before the place r leave the value at place r
    where that is below h, else the value at place r + n. Sectors with rows of more than one place or height meet their
    surroundings row by row.
    """
    shifts = F.sequence(F.lit(-1), F.lit(1))
    around = lambda rows, *cols: rows.withColumn("dx", F.explode(shifts)).withColumn("dy", F.explode(shifts)).select(*cols, (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    own = placed.where("sector IS NOT NULL").groupBy("sector").agg(F.count("*").alias("n"), F.collect_set(F.struct("cx", "cy", "height")).alias("at"))
    single = own.where("size(at) = 1").select("sector", "n", "at")
    single = single.select("sector", "n", F.col("at")[0]["cx"].alias("cx"), F.col("at")[0]["cy"].alias("cy"), F.col("at")[0]["height"].alias("height")).where("height IS NOT NULL")
    counts = placed.where("sector IS NOT NULL AND height IS NOT NULL").groupBy("cx", "cy", "height").count()
    near = around(counts, "height", "count").groupBy("cx", "cy", "height").agg(F.sum("count").alias("count"))
    ranked = near.withColumn("upto", F.sum("count").over(W.partitionBy("cx", "cy").orderBy("height")))
    kinds = single.groupBy("cx", "cy", "n").agg(F.lit(1).alias("_")).drop("_").join(near.groupBy("cx", "cy").agg(F.sum("count").alias("all")), ["cx", "cy"])
    kinds = kinds.where((F.col("all") - F.col("n")) * F.col("n") >= crowd).withColumn("r", F.floor((F.col("all") - F.col("n")) / 2))
    at = lambda place, name: F.min(F.when(F.col("upto") > place, F.col("height"))).alias(name)
    found = kinds.join(ranked, ["cx", "cy"]).groupBy("cx", "cy", "n").agg(at(F.col("r"), "below"), at(F.col("r") + F.col("n"), "above"))
    local = single.join(found, ["cx", "cy", "n"]).select("sector", F.when(F.col("below") < F.col("height"), F.col("below")).otherwise(F.col("above")).alias("median"))
    several = placed.join(own.where("size(at) > 1").select("sector"), "sector", "left_semi")
    pairs = around(several, "sector").join(placed.select("cx", "cy", F.col("sector").alias("other"), F.col("height").alias("h")), ["cx", "cy"]).where("sector <> other")
    listed = pairs.groupBy("sector").agg(F.sort_array(F.collect_list("h")).alias("hs")).where(F.size("hs") >= crowd)
    return local.unionByName(listed.select("sector", F.element_at("hs", F.floor(F.size("hs") / 2).cast("int") + 1).alias("median")))


def index_percentile(sorted_values: Column, share: float) -> Column:
    """The value at place floor(share * n), the last at most; no interpolation."""
    n = F.size(sorted_values)
    return F.element_at(sorted_values, F.least(n - 1, F.floor(n * F.lit(share)).cast("int")) + 1)


def index_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, joins (rows), the value at place floor(share * n) for each share (the last at most), and the most.

    Values are counted before they are ordered, so a group is as many rows as it has distinct values.
    """
    counts = rows.groupBy(by, value).count()
    group = W.partitionBy(by)
    placed = counts.withColumns({"_end": F.sum("count").over(group.orderBy(value)), "_n": F.sum("count").over(group)})
    at = lambda share: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(share)))
    found = [F.min(F.when(F.col("_end") > at(share), F.col(value))).alias(name) for name, share in shares.items()]
    return placed.groupBy(by).agg(F.max("_n").alias("joins"), *found, F.max(value).alias("most"))


def joins_by_flat(sectors: DataFrame, edges: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Percentiles of the difference across each distinct pair of neighbours with one flat. sectors: sector, flat, height."""
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda k: sectors.select(F.col("sector").alias(k), F.col("flat").alias(f"flat_{k}"), F.col("height").alias(f"h_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where("flat_a = flat_b")
    return index_percentiles(joined.select(F.col("flat_a").alias("flat"), F.abs(F.col("h_a") - F.col("h_b")).cast("long").alias("step")), "flat", "step", shares)


def angles_by_flat(planes: DataFrame, edges: DataFrame, shares: dict[str, float], least_area: float = 2.0) -> DataFrame:
    """Percentiles of the angle, in tenths of a degree, between sloped neighbours of one flat and of least_area at least.

    planes: sector, flat, area, pa, pb, pc (normal; level sectors have none).
    """
    sloped = planes.where((F.col("area") >= least_area) & F.col("pc").isNotNull() & ((F.col("pa") != 0) | (F.col("pb") != 0)))
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda k: sloped.select(F.col("sector").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("flat", "pa", "pb", "pc")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where("flat_a = flat_b")
    normal = lambda k: tuple(F.col(f"{c}_{k}") for c in ("pa", "pb", "pc"))
    tenths = F.bround(dihedral(normal("a"), normal("b")) * 10).cast("long")
    return index_percentiles(joined.select(F.col("flat_a").alias("flat"), tenths.alias("tenths")), "flat", "tenths", shares)


def widest(lines: DataFrame, by: str, size: str, top: int, tie: str) -> DataFrame:
    """The `top` longest lines of each map, and how many there are."""
    w = W.partitionBy(by)
    return lines.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(size), tie)).cast("long"), "lines": F.count("*").over(w)}).where(F.col("rank") <= top)


def open_sectors(edges: DataFrame, sector: str) -> DataFrame:
    """Sectors with a vertex that an odd number of edge ends meet; edges: sector, x1, y1, x2, y2."""
    ends = edges.select(sector, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v"))
    odd = ends.groupBy(sector, "v").count().where("count % 2 = 1")
    return odd.groupBy(sector).agg(F.count("*").alias("odd_vertices"))


def suspect_pockets(members: DataFrame, borders: DataFrame, ground: list[str], share: float = 0.75, least: float = 20.0) -> DataFrame:
    """Pockets of more than `least` area whose border is ground by more than `share`, largest first.

    members: sector, component, area; borders: a, b, texture of the sector b beyond each edge.
    """
    area = members.groupBy("component").agg(F.sum("area").alias("area"), F.count("*").alias("sectors")).where(F.col("area") > least)
    around = both_ways_within(members, borders).groupBy("component").agg(F.count("*").alias("edges"), F.count_if(F.col("texture").isin(ground)).alias("ground_edges"))
    return area.join(around, "component").where(F.col("ground_edges") > share * F.col("edges")).select("component", "sectors", "area", "edges", "ground_edges")


def both_ways_within(members: DataFrame, borders: DataFrame) -> DataFrame:
    """Edges that lead out of a component: component, b, texture."""
    own = members.select(F.col("sector").alias("a"), "component")
    beyond = members.select(F.col("sector").alias("b"), F.col("component").alias("_other"))
    return borders.join(own, "a").join(beyond, "b", "left").where("_other IS NULL OR _other <> component").select("component", "b", "texture")


def walk_phases(ticks: DataFrame, by: str, length: int) -> DataFrame:
    """Distance between the first and last place of each phase of `length` ticks. ticks: by, tick, x, y."""
    phased = ticks.withColumn("phase", F.floor(F.col("tick") / length).cast("long"))
    at = F.struct("x", "y")
    ends = phased.groupBy(by, "phase").agg(F.min_by(at, "tick").alias("p"), F.max_by(at, "tick").alias("q"), F.count("*").alias("ticks"))
    return ends.select(by, "phase", "ticks", F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")).alias("moved"))


def centres(edges: DataFrame, sector: str) -> DataFrame:
    """Mean of the ends of a sector's edges; a corner counts as often as edges end there. edges: sector, x1, y1, x2, y2."""
    ends = edges.select(sector, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v"))
    return ends.groupBy(sector).agg(F.avg("v.x").alias("cx"), F.avg("v.y").alias("cy"))


def dihedral(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Degrees between two planes by their normals (not of unit length)."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    size = lambda n: F.sqrt((n[0] * n[0] + n[1] * n[1] + n[2] * n[2]).cast("double"))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size(a) * size(b))))))
