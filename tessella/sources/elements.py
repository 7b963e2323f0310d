"""Ways from JSON elements, from coordinates that may be incomplete, and places by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENTS = "struct<elements:array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"
#: Fixed value: how bounds are rounded before a scan, in places of a degree.
PLACES = 6


def read_elements(texts: DataFrame, column: str = "value") -> DataFrame:
    """way id, tags, coords and closed of JSON answers; elements without geometry or with one point drop out, and so does text that is no JSON."""
    rows = texts.select(F.explode(F.from_json(column, ELEMENTS)["elements"]).alias("e")).where("e.geometry IS NOT NULL AND size(e.geometry) >= 2")
    return rows.select(F.col("e.id").alias("osm_id"), F.col("e.tags").alias("tags"), F.col("e.geometry").alias("coords"), (F.element_at("e.geometry", 1) == F.element_at("e.geometry", -1)).alias("closed"))


def selector(text: str) -> tuple[str, str, str | None]:
    """kind, key and value of kind["key"="value"]; any value without one. Anything else is an error."""
    import re

    found = re.fullmatch(r'(node|way|relation|nwr)\["([^"]+)"(?:="([^"]*)")?\]', text.strip())
    if not found:
        raise ValueError(f"not a selector: {text}")
    return found.groups()


def matches(tags: Column, selectors: list[str]) -> Column:
    """Whether any selector holds of a map of tags."""
    out = F.lit(False)
    for kind, key, value in map(selector, selectors):
        if kind in ("way", "nwr"):
            held = F.try_element_at(tags, F.lit(key))
            out = out | (F.coalesce(held == value, F.lit(False)) if value is not None else held.isNotNull())
    return out


def write_index(nodes: DataFrame, folder: str, cell: int, key: str = "way_id") -> int:
    """Writes whole ways by the cells that they touch; the number of ways left out, as a point is missing or there is one only.

    nodes: key, seq, x, y (null where unknown). A way is written once a cell, under the cell's column of the grid.
    """
    ways = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("points"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unknown"))
    whole = (F.col("unknown") == 0) & (F.size("points") >= 2)
    left_out = ways.where(~whole).count()
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    placed = ways.where(whole).drop("unknown").withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north"))
    placed.repartition("cx").sortWithinPartitions("cx", "cy").write.mode("overwrite").partitionBy("cx").parquet(folder)
    return left_out


def scan_index(index: DataFrame, box: tuple, cell: int, key: str = "way_id") -> DataFrame:
    """Ways of the index whose bounds overlap the box (closed): only the folders of its cells are read, each way comes once."""
    west, south, east, north = box
    low_x, low_y = west // cell, south // cell
    near = index.where(F.col("cx").between(low_x, east // cell) & F.col("cy").between(low_y, north // cell))
    near = near.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    first = lambda c, low, bound: F.col(c) == F.greatest(F.lit(low), F.floor(F.col(bound) / cell))
    return near.where(first("cx", low_x, "west") & first("cy", low_y, "south")).drop("cx", "cy")


def place_name(parish: Column, ward: Column, district: Column) -> Column:
    """Parish (ward where there is none) and district, once if they are equal."""
    local = F.when(F.coalesce(F.contains(F.lower(parish), F.lit("unparished")), F.lit(True)), ward).otherwise(parish)
    named = F.nullif(F.trim(local), F.lit(""))
    return F.when(named == district, district).otherwise(F.concat_ws(", ", named, F.nullif(district, F.lit(""))))


def look_up(keys: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """keys with the place of their trimmed upper-case key; unknown ones have nulls. places has unique keys."""
    placed = places.withColumn("_k", F.upper(F.trim(key))).drop(key)
    return keys.withColumn("_k", F.upper(F.trim(key))).join(placed, "_k", "left").drop("_k")


def mosaic(boxes: DataFrame, cells: DataFrame, present: DataFrame) -> DataFrame:
    """query_id, cells, and whether all of them are present: a raster is made of all its squares or not at all. cells: query_id, cell."""
    needed = cells.join(present.select("cell").distinct().withColumn("_here", F.lit(1)), "cell", "left")
    return boxes.select("query_id").join(needed.groupBy("query_id").agg(F.count("*").alias("cells"), F.count("_here").alias("here")), "query_id", "left").select("query_id", F.coalesce("cells", F.lit(0).cast("long")).alias("cells"), F.coalesce(F.col("cells") == F.col("here"), F.lit(False)).alias("complete"))


def query_text(selectors: list[str], south: Column, west: Column, north: Column, east: Column) -> Column:
    """The query of all selectors in bounds, which are rounded to PLACES decimals."""
    box = F.concat_ws(",", *[F.format_string(f"%.{PLACES}f", c) for c in (south, west, north, east)])
    for text in selectors:
        selector(text)  # an error where one is unreadable
    return F.concat(F.lit("("), *[F.concat(F.lit(text + "("), box, F.lit(");")) for text in selectors], F.lit(")"))
