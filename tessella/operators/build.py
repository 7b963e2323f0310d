"""A tile from its features: layers of polygons in order, their arrangement, sectors, lines, and what the tile shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import tags
from tessella.operators import arrangement, closure, faces, polygons, rollup

# Layers from the ground up; how far corners may be dropped, in metres; least areas, in square metres.
LAYERS = ["base", "landuse", "water", "roads", "railways", "barriers", "buildings"]
TOLERANCE = {"buildings": 0.4, "roads": 0.5, "railways": 0.5, "barriers": 0.5, "water": 1.0, "landuse": 1.5}
LEAST_AREA = {"buildings": 8.0, "landuse": 40.0}


def layer(features: DataFrame, name: str, box: tuple) -> DataFrame:
    """tile, osm_id, layer, bridge and points of the polygons of one layer, clipped to the tile.

    features: tile, osm_id, bucket, points (array of x, y in metres), width_m (of lines; others are rings), bridge.
    """
    own = features.where(F.col("bucket") == name)
    if name in ("roads", "railways", "barriers"):
        wide = polygons.corridors(own.where("width_m > 0").withColumn("half", F.col("width_m") / 2), "half")
        own = wide.where(F.size("parts") > 0).withColumn("points", F.col("parts")[0]).drop("parts", "half")
    else:
        own = own.where(F.size("points") >= 4)
    kept = polygons.clean(own, box, TOLERANCE[name], LEAST_AREA.get(name, 0.0))
    return kept.select("tile", "osm_id", F.lit(name).alias("layer"), "bridge", F.col("parts")[0].alias("points"))


def specs(features: DataFrame, box: tuple) -> DataFrame:
    """The polygons of all layers with their ordinal in the tile: layers in order, bridges last in theirs, then by id.

    The whole tile is the base, so that every point of it has an owner.
    """
    west, south, east, north = map(float, box)
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((west, south), (east, south), (east, north), (west, north))])
    out = features.select("tile").distinct().select("tile", F.lit(None).cast("long").alias("osm_id"), F.lit("base").alias("layer"), F.lit(None).cast("string").alias("bridge"), corners.alias("points"))
    for name in LAYERS[1:]:
        out = out.unionByName(layer(features, name, box))
    place = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    ordered = faces.ordered_layers(out.withColumn("place", place), "tile", "place", tags.is_bridge(F.col("bridge")).cast("int"), "osm_id")
    return ordered.select("tile", F.col("ordinal").alias("spec"), "osm_id", "layer", "points")


@dataclass
class Tile:
    """The parts of built tiles: specs, directed edges of sectors (uses), lines with their sides, shares of cover, and whether faces are closed."""

    specs: DataFrame
    uses: DataFrame
    lines: DataFrame
    cover: DataFrame
    closed: DataFrame

    def sectors(self) -> DataFrame:
        """tile, face, spec and area, one row a sector."""
        return self.uses.groupBy("tile", "face").agg(F.first("spec").alias("spec"), F.first("area").alias("area"))


def build(features: DataFrame, box: tuple, style: dict[str, tuple[int, int, str]], units: int = 1) -> Tile:
    """Tiles from features; style: layer to floor, ceiling and wall; units of the result a metre."""
    known = specs(features, box)
    corner = F.posexplode("points").alias("seq", "p")
    at = lambda c, low: F.bround((F.col(f"p.{c}") - low) * units).cast("long").alias(c)
    rings = known.select("tile", "spec", corner).select("tile", "spec", "seq", at("x", box[0]), at("y", box[1]))
    uses = arrangement.outlines(rings)
    look: dict[str, Column] = {k: F.create_map(*[x for name, s in style.items() for x in (F.lit(name), F.lit(s[i]))]) for i, k in enumerate(("floor", "ceiling", "wall"))}
    sectors = uses.select("tile", "face", "spec").distinct().join(known.select("tile", "spec", "layer"), ["tile", "spec"])
    faced = sectors.select("tile", "face", *[F.try_element_at(m, F.col("layer")).alias(k) for k, m in look.items()])
    size = ((box[2] - box[0]) * units, (box[3] - box[1]) * units)
    areas = arrangement.owned_areas(known.select("tile", "spec", "layer", "points"), box[:2], units)
    cover = rollup.cover_percent(areas.select("tile", F.col("layer").alias("cover"), "area"), "tile", "cover")
    closed = closure.closed(known.select("tile", "points"), box[:2], size, units)
    return Tile(known, uses, faces.lines(uses, faced, (0, 0, *size)), cover, closed)


def summary(tile: Tile) -> DataFrame:
    """sectors, lines, one-sided lines and specs by layer of each tile."""
    sectors = tile.sectors().groupBy("tile").agg(F.count("*").alias("sectors"))
    lines = tile.lines.groupBy("tile").agg(F.count("*").alias("lines"), F.count_if("blocking").alias("one_sided"))
    return sectors.join(lines, "tile").join(rollup.layer_counts(tile.specs, "tile", LAYERS[1:]), "tile")
