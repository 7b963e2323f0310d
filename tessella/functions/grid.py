"""Grid arithmetic as column expressions: tiles, National Grid squares, names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the grids.
UNITS_PER_METRE, TILE_M, GRID_M = 32, 800, 5000
GRID_LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"


def tile_index(coordinate: Column, size: int = TILE_M) -> Column:
    """Floor division, right for negative coordinates too."""
    return F.floor(coordinate / F.lit(float(size))).cast("long")


def tile_id(ix: Column, iy: Column, size: int = TILE_M) -> Column:
    return F.format_string(f"bng{size}-%d-%d", ix, iy)


def to_units(coordinate: Column, origin: Column) -> Column:
    return (coordinate - origin) * UNITS_PER_METRE


def grid_square(easting: Column, northing: Column) -> Column:
    """Letters of the 100 km square; raises outside the grid."""
    e, n = F.floor(easting / 100000), F.floor(northing / 100000)
    row = F.lit(19) - n
    first = row - F.pmod(row, F.lit(5)) + F.floor((e + 10) / 5)
    second = F.pmod(row * 5, F.lit(25)) + F.pmod(e, F.lit(5))
    letter = lambda i: F.substring(F.lit(GRID_LETTERS), i.cast("int") + 1, F.lit(1))
    inside = e.between(0, 6) & n.between(0, 12)
    return F.when(inside, F.concat(letter(first), letter(second))).otherwise(F.raise_error(F.lit("outside the National Grid")))


def grid_tile(easting: Column, northing: Column, size: int = GRID_M) -> Column:
    """Name of the 5 km square that holds a point."""
    kilometres = lambda c: F.lpad(F.floor(F.pmod(F.floor(c / size) * size, F.lit(100000)) / 1000).cast("string"), 2, "0")
    return F.concat(grid_square(easting, northing), kilometres(easting), kilometres(northing))


def cells(low: Column, high: Column, size: int) -> Column:
    """Origins of the cells that [low, high) touches: half-open at the far edge."""
    first, last = F.floor(low / size) * size, (F.ceil(high / size) - 1) * size
    return F.when(last >= first, F.sequence(first, last, F.lit(size).cast("long"))).otherwise(F.array().cast("array<long>"))


def map_name(index: Column, count: Column) -> Column:
    """MAP01... while 99 fit, else M0001..."""
    return F.when(count <= 99, F.concat(F.lit("MAP"), F.lpad((index + 1).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("M"), F.lpad((index + 1).cast("string"), 4, "0")))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def octant(angle: Column) -> Column:
    return F.floor(F.pmod(angle, F.lit(360)) / 45).cast("int")


def with_osgb(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """easting and northing of WGS84 degrees by the published Helmert shift and transverse Mercator series (about 2 m).

    Intermediate values are columns of their own, so that none is written out again wherever it is used.
    """
    rad, c = math.radians, F.col
    # Fixed values of the ellipsoids, of the Helmert shift and of the National Grid.
    a0, b0 = 6378137.0, 6356752.3141
    tx, ty, tz, s = -446.448, 125.157, -542.060, 20.4894e-6
    rx, ry, rz = rad(-0.1502 / 3600), rad(-0.2470 / 3600), rad(-0.8421 / 3600)
    a, b, f0, phi0, lam0, n0, e0 = 6377563.396, 6356256.909, 0.9996012717, rad(49), rad(-2), -100000.0, 400000.0
    e20, e2, n = 1 - (b0 / a0) ** 2, 1 - (b / a) ** 2, (a - b) / (a + b)
    kept = df.columns
    df = df.withColumns({"_p": F.radians(lat), "_l": F.radians(lon)})
    df = df.withColumn("_nu", a0 / F.sqrt(1 - e20 * F.sin("_p") * F.sin("_p")))
    df = df.withColumns({"_x": c("_nu") * F.cos("_p") * F.cos("_l"), "_y": c("_nu") * F.cos("_p") * F.sin("_l"), "_z": c("_nu") * (1 - e20) * F.sin("_p")})
    x, y, z = c("_x"), c("_y"), c("_z")
    df = df.withColumns({"_x": tx + (1 + s) * x - rz * y + ry * z, "_y": ty + rz * x + (1 + s) * y - rx * z, "_z": tz - ry * x + rx * y + (1 + s) * z})
    df = df.withColumns({"_r": F.sqrt(x * x + y * y), "_l": F.atan2("_y", "_x")})
    df = df.withColumn("_p", F.atan2(z, c("_r") * (1 - e2)))
    for _ in range(4):
        df = df.withColumn("_nu", a / F.sqrt(1 - e2 * F.sin("_p") * F.sin("_p")))
        df = df.withColumn("_p", F.atan2(z + e2 * c("_nu") * F.sin("_p"), c("_r")))
    df = df.withColumns({"_s": F.sin("_p"), "_c": F.cos("_p"), "_t": F.tan("_p") * F.tan("_p"), "_d": c("_p") - phi0, "_e": c("_p") + phi0, "_dl": c("_l") - lam0})
    df = df.withColumn("_q", 1 - e2 * c("_s") * c("_s"))
    df = df.withColumns({"_nu": a * f0 / F.sqrt("_q"), "_rho": a * f0 * (1 - e2) * F.pow("_q", F.lit(-1.5))})
    df = df.withColumn("_h", c("_nu") / c("_rho") - 1)
    d, t, sin, cos, nu, rho, tan2, eta2, dl = (c(k) for k in ("_d", "_e", "_s", "_c", "_nu", "_rho", "_t", "_h", "_dl"))
    m = b * f0 * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(t) + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * t) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * t))
    north = m + n0 + nu / 2 * sin * cos * dl**2 + nu / 24 * sin * cos**3 * (5 - tan2 + 9 * eta2) * dl**4 + nu / 720 * sin * cos**5 * (61 - 58 * tan2 + tan2 * tan2) * dl**6
    east = e0 + nu * cos * dl + nu / 6 * cos**3 * (nu / rho - tan2) * dl**3 + nu / 120 * cos**5 * (5 - 18 * tan2 + tan2 * tan2 + 14 * eta2 - 58 * tan2 * eta2) * dl**5
    return df.select(*kept, east.alias("easting"), north.alias("northing"))


def bounds(points: list[tuple[Column, Column]]) -> tuple[Column, Column, Column, Column]:
    """west, south, east, north of the corners: all of them count, as a turned box's extremes may lie at any."""
    xs, ys = zip(*points)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def lump_name(prefix: str, index: Column, digits: int = 2) -> Column:
    """Prefix and number from 1; raises beyond eight characters."""
    number = (index + 1).cast("string")
    name = F.concat(F.lit(prefix), F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number))
    return F.when(F.length(name) <= 8, name).otherwise(F.raise_error(F.concat(F.lit("longer than eight characters: "), name)))


def degrees_text(value: Column, positive: str, negative: str) -> Column:
    """Five decimals and the hemisphere."""
    return F.concat(F.format_string("%.5f", F.abs(value)), F.when(value >= 0, positive).otherwise(negative))


def shade(value: Column, low: Column, span: Column) -> Column:
    """Colour of a height: dark green below to pale above, as (r, g, b)."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((value - low) / F.nullif(span, F.lit(0.0)), F.lit(0.0))))
    # The darkest colour, and the way to the palest.
    return F.struct(*[(F.lit(float(a)) + share * b).cast("int").alias(k) for k, a, b in (("r", 46, 150), ("g", 74, 130), ("b", 46, 110))])
