"""Exact geometry on integer coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cross(ax, ay, bx, by, px, py) -> Column:
    """Twice the signed area of a, b, p."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segment_meets_box(x1, y1, x2, y2, west, south, east, north) -> Column:
    """Closed test: bounding boxes overlap and the corners do not lie on one side of the line."""
    sides = [cross(x1, y1, x2, y2, x, y) for x in (west, east) for y in (south, north)]
    overlap = (F.least(x1, x2) <= east) & (F.greatest(x1, x2) >= west) & (F.least(y1, y2) <= north) & (F.greatest(y1, y2) >= south)
    return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def crosses_ray(x1, y1, x2, y2, px, py) -> Column:
    """Whether the edge crosses the ray from p to the east; an odd number of crossings is inside."""
    up = (y1 <= py) & (y2 > py) & (cross(x1, y1, x2, y2, px, py) > 0)
    down = (y1 > py) & (y2 <= py) & (cross(x1, y1, x2, y2, px, py) < 0)
    return up | down


def plane_height(a, b, c, d, x, y, level) -> Column:
    """Height of a sloped floor at a point; level floors have no plane."""
    return F.coalesce(-(a * x + b * y + d) / c, level)


def plane_through(p, q, r) -> tuple[Column, Column, Column, Column]:
    """a, b, c, d of ax + by + cz + d = 0 through three (x, y, z) corners, c upwards; c is zero where they lie on a line."""
    ux, uy, uz = (q[i] - p[i] for i in range(3))
    vx, vy, vz = (r[i] - p[i] for i in range(3))
    a, b, c = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    up = F.when(c < 0, -1).otherwise(1)
    return a * up, b * up, c * up, -(a * p[0] + b * p[1] + c * p[2]) * up
