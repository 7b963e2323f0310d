"""What the tags of a way say: bucket, lengths, heights, widths, land cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths in metres by road class.
ROAD_WIDTHS = {"motorway": 16.0, "motorway_link": 8.0, "trunk": 14.0, "trunk_link": 8.0, "primary": 11.0, "primary_link": 7.0, "secondary": 10.0, "secondary_link": 7.0, "tertiary": 8.5, "tertiary_link": 6.0, "residential": 7.0, "unclassified": 6.5, "living_street": 6.0, "service": 4.5, "pedestrian": 5.0, "track": 3.5, "footway": 2.0, "path": 1.8, "cycleway": 2.5, "steps": 2.0, "bridleway": 2.0}
# Heights in metres by building class, and where none is known.
BUILDING_HEIGHTS = {"church": 14.0, "cathedral": 20.0, "chapel": 10.0, "school": 9.0, "hospital": 14.0, "industrial": 9.0, "warehouse": 9.0, "retail": 7.5, "commercial": 10.0, "apartments": 13.0, "hotel": 13.0, "garage": 2.6, "garages": 2.6, "shed": 2.4, "hut": 2.4, "greenhouse": 2.6, "bungalow": 4.5, "terrace": 7.0, "house": 6.5, "detached": 7.0, "semidetached_house": 6.5}
DEFAULT_HEIGHT, STOREY = 7.0, 3.1
# Widths of rail corridors, and railway values that are no track.
RAIL_WIDTHS = {"rail": 9.0, "light_rail": 6.0, "subway": 6.0, "tram": 5.0, "narrow_gauge": 4.0, "preserved": 6.0, "disused": 6.0, "siding": 5.0, "spur": 5.0, "yard": 12.0}
RAIL_SKIPPED = ["station", "halt", "platform", "subway_entrance", "level_crossing", "crossing", "signal", "switch", "buffer_stop", "milestone", "razed", "abandoned", "construction", "proposed", "turntable", "roundhouse"]
# Barriers, width and height in metres.
BARRIERS = {"hedge": (0.9, 1.7), "hedge_bank": (1.2, 1.8), "fence": (0.15, 1.3), "wall": (0.35, 1.8), "dry_stone_wall": (0.5, 1.4), "retaining_wall": (0.4, 1.0), "city_wall": (0.8, 4.0), "guard_rail": (0.1, 0.8), "handrail": (0.08, 1.0)}
# The cover of each land use, leisure and natural value.
LAND_COVER = {"farmland": "farm", "vineyard": "farm", "allotments": "farm", "plant_nursery": "farm", "greenhouse_horticulture": "farm", "meadow": "grass", "grass": "grass", "village_green": "grass", "recreation_ground": "grass", "residential": "grass", "cemetery": "grass", "greenfield": "grass", "park": "grass", "garden": "grass", "flowerbed": "grass", "pitch": "grass", "golf_course": "grass", "sports_centre": "grass", "common": "grass", "grassland": "grass", "horse_riding": "grass", "dog_park": "grass", "resort": "grass", "religious": "grass", "orchard": "wood", "forest": "wood", "brownfield": "wood", "nature_reserve": "wood", "wood": "wood", "scrub": "wood", "heath": "wood", "farmyard": "paved", "industrial": "paved", "commercial": "paved", "retail": "paved", "quarry": "paved", "construction": "paved", "railway": "paved", "military": "paved", "playground": "paved", "shingle": "paved", "bare_rock": "paved", "scree": "paved", "schoolyard": "paved", "outdoor_seating": "paved", "sand": "beach", "beach": "beach", "dune": "beach", "swimming_pool": "water", "swimming_area": "water", "aquaculture": "water", "basin": "water", "reservoir": "water", "salt_pond": "water", "wetland": "terrain", "marsh": "terrain", "cliff": "terrain"}


def lookup(table: dict, value: Column) -> Column:
    """A fixed table as one expression; null where the value is not in it."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(value, F.lit("")))


def parse_length(value: Column) -> Column:
    """'12', '12 m', '12,5m', feet as 40' or 40ft; anything else is null."""
    text = F.regexp_replace(F.trim(F.lower(value)), ",", ".")
    number = lambda c: F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), c.try_cast("double"))
    return (
        F.when(text == "", F.lit(None).cast("double"))
        .when(text.endswith("'"), number(F.regexp_replace(text, "'$", "")) * 0.3048)
        .when(text.endswith("ft"), number(F.trim(F.regexp_replace(text, "ft$", ""))) * 0.3048)
        .otherwise(number(F.trim(F.regexp_replace(text, "m$", ""))))
    )


def bucket(building, highway, railway, barrier, waterway, natural, landuse, leisure, closed, points) -> Column:
    """The first tag decides; where its condition fails, the way is dropped (null) and does not fall through."""
    none = F.lit(None).cast("string")
    return (
        F.when(building.isNotNull(), F.when(closed & (points >= 4), "buildings").otherwise(none))
        .when(highway.isNotNull(), "roads")
        .when(railway.isNotNull(), "railways")
        .when(barrier.isNotNull() & waterway.isNull(), "barriers")
        .when(natural == "coastline", "coastline")
        .when((natural == "water") | (waterway == "riverbank"), F.when(closed, "water").otherwise(none))
        .when(F.coalesce(landuse, leisure, natural).isNotNull() & closed, "landuse")
    )


def building_height(height: Column, levels: Column, building: Column, amenity: Column) -> Column:
    """The tag, else storeys, else the class, else a church's for places of worship, else the default."""
    explicit = parse_length(height)
    storeys = F.regexp_replace(levels, ",", ".").try_cast("double") * STOREY + 1.0
    return F.coalesce(F.when(explicit > 0, explicit), storeys, lookup(BUILDING_HEIGHTS, F.coalesce(building, F.lit("yes"))), F.when(amenity == "place_of_worship", BUILDING_HEIGHTS["church"]), F.lit(DEFAULT_HEIGHT))


def width(tag: Column, kind: Column, table: dict, skipped: list[str] = ()) -> Column:
    """A zero or unreadable width falls back to the class; null where that is unknown or skipped."""
    found = F.coalesce(F.nullif(parse_length(tag), F.lit(0.0)), lookup(table, kind))
    return F.when(~kind.isin(list(skipped)), found) if skipped else found


def land_cover(leisure: Column, landuse: Column, natural: Column, amenity: Column) -> Column:
    """Cover of the first of leisure, landuse, natural that is known; a car park is road; else null."""
    return F.coalesce(*[lookup(LAND_COVER, c) for c in (leisure, landuse, natural)], F.when(amenity == "parking", "road"))


def storeys(height: Column) -> Column:
    """Storeys a height implies, 1 to 4, rounding halves to even."""
    return F.greatest(F.lit(1), F.least(F.lit(4), F.bround(height / STOREY).cast("int")))


# Facade keys by building class, those of houses in turn, the footprint and height that overrule them (metres), and a texture's height a storey.
FACADES = {"church": "S", "cathedral": "S", "chapel": "S", "industrial": "G", "warehouse": "G", "commercial": "G", "retail": "G", "office": "G", "garage": "G", "garages": "G", "shed": "G", "hut": "G", "hotel": "G", "apartments": "G", "train_station": "G", "university": "G", "supermarket": "G", "civic": "G", "public": "G", "sports_hall": "G", "stadium": "G", "farm_auxiliary": "G", "barn": "G", "hospital": "G", "greenhouse": "H", "glasshouse": "H", "school": "R"}
DOMESTIC, BIG_M2, TALL_M = ("R", "Y", "R", "N", "Y"), 400.0, 20.0
# Wall materials by building class.
WALLS = {"church": "stone", "cathedral": "stone", "chapel": "stone", "industrial": "grey", "warehouse": "grey", "commercial": "grey", "retail": "grey", "garage": "dark", "garages": "dark", "shed": "dark"}
WALL_SCALES = {"brick": 3.0, "grey": 3.0, "dark": 3.0, "stone": 2.0}
# Heights that a measurement must lie between, and the least width of a barrier, in metres.
MEASURED, LEAST_BARRIER = (2.0, 350.0), 0.25


def facade(building: Column, amenity: Column, historic: Column, osm_id: Column, height: Column, footprint: Column) -> Column:
    """Key of a building's facade: its class, else a church's, else by size, else a house's in turn; tall ones have glass."""
    kind = F.coalesce(building, F.lit("yes"))
    worship = F.coalesce(amenity == "place_of_worship", F.lit(False)) | (F.coalesce(historic, F.lit("")) != "")
    house = F.element_at(F.array(*[F.lit(k) for k in DOMESTIC]), (F.pmod(osm_id, F.lit(len(DOMESTIC))) + 1).cast("int"))
    key = F.coalesce(lookup(FACADES, kind), F.when(worship, "S"), F.when(kind.isin("yes", "") & (footprint >= BIG_M2), "G"), house)
    return F.when((height >= TALL_M) & (key != "H"), "T").otherwise(key)


def wall(building: Column, amenity: Column, historic: Column) -> Column:
    worship = F.coalesce(amenity == "place_of_worship", F.lit(False)) | (F.coalesce(historic, F.lit("")) != "")
    return F.coalesce(lookup(WALLS, F.coalesce(building, F.lit("yes"))), F.when(worship, "stone"), F.lit("brick"))


def wall_scale(material: Column) -> Column:
    return F.coalesce(lookup(WALL_SCALES, material), F.lit(1.0))


def barrier_size(barrier: Column) -> tuple[Column, Column]:
    """Width (at least a quarter of a metre) and height; null for kinds that are not drawn."""
    width_of, height_of = ({k: v[i] for k, v in BARRIERS.items()} for i in (0, 1))
    return F.when(lookup(width_of, barrier).isNotNull(), F.greatest(lookup(width_of, barrier), F.lit(LEAST_BARRIER))), lookup(height_of, barrier)


def accepted_height(measured: Column, tagged: Column) -> Column:
    """The measurement where it can be a building's, else what the tags say."""
    return F.when(measured.between(*MEASURED), measured).otherwise(tagged)


def is_bridge(bridge: Column) -> Column:
    return ~F.coalesce(bridge, F.lit("no")).isin("no", "")


def trimmed(shares: Column) -> Column:
    """A map of cover shares in percent without those of half a percent or less."""
    return F.map_filter(shares, lambda _, share: share > 0.5)
