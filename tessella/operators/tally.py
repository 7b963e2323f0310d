"""Counts of features at places, where pairs of both would be too many to be rows.

The places (boxes or points) are distinct and go to all tasks (32 bytes each); each task passes its features over them in
blocks of neighbouring places, as matrices, and returns a row a place. Coordinates are integers, and results exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix at most; coordinates below FAR have cross products that doubles hold.
CELLS, FAR = 300_000, 2**25
#: Rows of a histogram at most, so that sums of 32-bit halves stay below 2**53.
ROWS = 1_000_000
#: What rounding may add to a squared distance, and what equal rounded distances may differ by.
NEAR = 1e-5


class Places:
    """Distinct rows of integer columns, in blocks of those that share a cell by their first two columns."""

    def __init__(self, columns: list[np.ndarray], cell: int):
        cx, cy = columns[0] // cell, columns[1] // cell
        order = np.lexsort((columns[1], columns[0], cy, cx))
        self.columns = [c[order] for c in columns]
        cx, cy = cx[order], cy[order]
        first = np.flatnonzero(np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])) if len(cx) else np.array([], int)
        self.blocks = [slice(a, b) for a, b in zip(first.tolist(), [*first.tolist()[1:], len(cx)])]

    def __len__(self) -> int:
        return len(self.columns[0])


def _places(df: DataFrame, names: list[str], cell: int):
    """Broadcast places of the rows without nulls."""
    found = df.select(*[F.col(n).cast("long").alias(n) for n in names]).dropna().distinct().toArrow()
    return df.sparkSession.sparkContext.broadcast(Places([found.column(n).to_numpy() for n in names], cell))


def _numbers(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Doubles where cross products of the integers fit, else Python's integers."""
    far = max((max(abs(int(c.min())), abs(int(c.max()))) for c in columns if len(c)), default=0) >= FAR
    return [c.astype(object if far else float) for c in columns]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _per_place(features: DataFrame, places, names: list[str], sums: int, kernel: Callable, rows: int = 1) -> DataFrame:
    """names and s0, s1, ...: what kernel(batch, places, totals) adds to totals (sums x places), over all tasks."""
    schema = ", ".join(f"{c} long" for c in [*names, *[f"s{i}" for i in range(sums)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        totals = np.zeros((sums, len(known)), np.int64)
        for batch in _gathered(batches, rows):
            if batch.num_rows and len(known):
                kernel(batch, known, totals)
        some = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in [*known.columns, *totals]], names=[x.split()[0] for x in schema.split(", ")])

    return features.mapInArrow(run, schema).groupBy(*names).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(sums)])


def _id_sum():
    """The sum of ids whose halves were added up by themselves; an error beyond the range of long."""
    return F.col("s2") * F.lit(2**32) + F.col("s1")


def _halves(ids: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(ids), np.int64), ids & (2**32 - 1), ids >> 32])


def _grouped(edges: DataFrame) -> DataFrame:
    """way_id and the list of its edges."""
    return edges.dropna(subset=["x1", "y1", "x2", "y2"]).where("way_id IS NOT NULL").groupBy("way_id").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("edges"))


def _edges(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each edge, and x1, y1, x2, y2."""
    column = batch.column(1)
    flat = column.flatten()
    return np.repeat(np.arange(batch.num_rows), pc.list_value_length(column).to_numpy()), [flat.field(k).to_numpy() for k in range(4)]


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))


def _folded(join: np.ufunc, m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The rows of m from each first to the next one joined; short runs go row by row for all of them at once."""
    length = np.diff(np.append(first, len(m)))
    if length.max(initial=0) > 16:
        return join.reduceat(m, first, axis=0)
    out = m[first]
    for k in range(1, length.max(initial=0)):
        some = np.flatnonzero(length > k)
        out[some] = join(out[some], m[first[some] + k])
    return out


def _runs(rows: np.ndarray, width: int) -> Iterator[slice]:
    """Slices of sorted rows with few cells each that part no row from its equals."""
    a, step = 0, max(1, CELLS // max(1, width))
    while a < len(rows):
        b = len(rows) if a + step >= len(rows) else int(np.searchsorted(rows, rows[a + step], "left"))
        if b <= a:
            b = int(np.searchsorted(rows, rows[a], "right"))
        yield slice(a, b)
        a = b


def lines_at_boxes(boxes: DataFrame, segments: DataFrame, cell: int) -> DataFrame:
    """q_west, q_south, q_east, q_north, s0: ways with a segment that meets the box (closed). segments: way_id, x1, y1, x2, y2."""
    names = ["q_west", "q_south", "q_east", "q_north"]

    def kernel(batch, known, totals):
        way, ints = _edges(batch)
        numbers = _numbers([*ints, *known.columns])
        x1, y1, x2, y2 = numbers[:4]
        dx, dy = x2 - x1, y2 - y1
        up = lambda v: np.maximum(v, 0)
        # The largest and least cross product of a box's corners: which corner it is depends on the segment's direction only.
        form = np.stack([up(dx), -up(-dx), -up(dy), up(-dy), dy * x1 - dx * y1], 1)
        low_x, high_x, low_y, high_y = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
        for block in known.blocks:
            west, south, east, north = (c[block] for c in numbers[4:])
            w, s, e, n = west.min(), south.min(), east.max(), north.max()
            near = np.flatnonzero((low_x <= e) & (high_x >= w) & (low_y <= n) & (high_y >= s))
            f = form[near]
            near = near[(f @ np.array([n, s, w, e, 1], f.dtype) >= 0) & (f @ np.array([s, n, e, w, 1], f.dtype) <= 0)]
            one = np.ones(len(west), f.dtype)
            most, least = np.stack([north, south, west, east, one]), np.stack([south, north, east, west, one])
            for part in _runs(way[near], len(west)):
                at = near[part]
                f = form[at]
                meets = (f @ most >= 0) & (f @ least <= 0)
                meets &= low_x[at, None] <= east
                meets &= high_x[at, None] >= west
                meets &= low_y[at, None] <= north
                meets &= high_y[at, None] >= south
                meets = _folded(np.logical_or, meets.astype(bool, copy=False), _starts(way[at]))
                totals[0, block] += (np.ones(len(meets), np.float32) @ meets.astype(np.float32)).astype(np.int64)  # fewer rows than 2**24

    return _per_place(_grouped(segments), _places(boxes, names, cell), names, 1, kernel)


def rings_at_points(points: DataFrame, rings: DataFrame, cell: int) -> DataFrame:
    """px, py, s0, id_sum: rings around the point (by the parity of ray crossings), and the sum of their ids. rings: way_id, x1, y1, x2, y2."""

    def kernel(batch, known, totals):
        way, ints = _edges(batch)
        ids = _halves(batch.column(0).to_numpy())
        numbers = _numbers([*ints, *known.columns])
        x1, y1, x2, y2, px, py = numbers
        level = y1 != y2
        way, x1, y1, x2, y2 = way[level], x1[level], y1[level], x2[level], y2[level]
        down = y1 > y2
        x1, y1, x2, y2 = np.where(down, x2, x1), np.where(down, y2, y1), np.where(down, x1, x2), np.where(down, y1, y2)
        form = np.stack([-(y2 - y1), x2 - x1, (y2 - y1) * x1 - (x2 - x1) * y1], 1)
        low_x, high_x = np.minimum(x1, x2), np.maximum(x1, x2)
        for block in known.blocks:
            x, y = px[block], py[block]
            w, e, s, n = x.min(), x.max(), y.min(), y.max()
            near = np.flatnonzero((y1 <= n) & (y2 > s) & (high_x > w))
            f = form[near]
            corners = [f @ np.array([u, v, 1], f.dtype) for u in (w, e) for v in (s, n)]
            right, left = np.minimum.reduce(corners) > 0, np.maximum.reduce(corners) <= 0
            whole = (y1[near] <= s) & (y2[near] > n)
            # An edge beside the block that spans it turns all its points over, or none.
            odd = np.bincount(way[near[whole & right]], minlength=batch.num_rows) % 2 == 1
            near = near[~left & ~(whole & right)]
            rest = odd.copy()
            rest[way[near]] = False
            totals[:, block] += ids[:, rest].sum(1)[:, None]
            points_ = np.stack([x, y, np.ones(len(x), f.dtype)])
            for part in _runs(way[near], len(x)):
                at = near[part]
                hit = form[at] @ points_ > 0
                hit &= y1[at, None] <= y
                hit &= y2[at, None] > y
                first = _starts(way[at])
                rows = way[at][first]
                hit = _folded(np.logical_xor, hit.astype(bool, copy=False), first) ^ odd[rows, None]
                totals[:, block] += (ids[:, rows].astype(float) @ hit.astype(float)).astype(np.int64)

    made = _per_place(_grouped(rings), _places(points, ["px", "py"], cell), ["px", "py"], 3, kernel)
    return made.select("px", "py", "s0", _id_sum().alias("id_sum"))


def _under(ux: np.ndarray, uy: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Sums of weights over the points (x, y) at or below each (ux[at_x], uy[at_y]); ux and uy are sorted.

    Whole blocks of the grid of ranks come from a histogram, the strips beside them from two finer ones, and the points of
    the last block one by one.
    """
    rx, ry = np.searchsorted(ux, x), np.searchsorted(uy, y)
    inside = (rx < len(ux)) & (ry < len(uy))
    rx, ry, weights = rx[inside], ry[inside], weights[:, inside]
    bx, by = int(len(ux) ** 0.5) + 1, int(len(uy) ** 0.5) + 1
    nx, ny = len(ux) // bx + 1, len(uy) // by + 1
    gx, gy, qx, qy = rx // bx, ry // by, at_x // bx, at_y // by
    block, asked = gx * ny + gy, qx * ny + qy
    order = np.argsort(block, kind="stable")
    first, end = (np.searchsorted(block[order], asked, side) for side in ("left", "right"))
    query = np.repeat(np.arange(len(asked)), end - first)
    point = order[np.arange(len(query)) - np.repeat(np.cumsum(end - first) - (end - first), end - first) + np.repeat(first, end - first)]
    hit = (rx[point] <= at_x[query]) & (ry[point] <= at_y[query])
    query, point = query[hit], point[hit]
    out = np.empty((len(weights), len(at_x)), np.int64)
    before = lambda a, axis: np.cumsum(a, axis) - a
    for i, w in enumerate(weights.astype(float)):
        coarse = before(before(np.bincount(block, w, nx * ny).reshape(nx, ny), 0), 1)
        tall = before(np.bincount(rx * ny + gy, w, nx * bx * ny).reshape(nx, bx, ny).cumsum(1), 2).reshape(-1, ny)
        wide = before(np.bincount(ry * nx + gx, w, ny * by * nx).reshape(ny, by, nx).cumsum(1), 2).reshape(-1, nx)
        out[i] = (coarse[qx, qy] + tall[at_x, qy] + wide[at_y, qx] + np.bincount(query, w[point], len(at_x))).astype(np.int64)
    return out


def boxes_at_boxes(places: DataFrame, boxes: DataFrame) -> DataFrame:
    """q_west, q_south, q_east, q_north, s0, id_sum: boxes (way_id, west, south, east, north) that overlap the place (closed), and the sum of their ids.

    No side of a place or a box ends before it begins. A box overlaps in x if it begins at or before q_east and does not end before q_west, and so in y: four counts of points
    below a corner.
    """
    names = ["q_west", "q_south", "q_east", "q_north"]

    def kernel(batch, known, totals):
        ids, *sides = (batch.column(i).to_numpy() for i in range(5))
        w, s, e, n = known.columns
        ends = {k: np.unique(v, return_inverse=True) for k, v in (("e", e), ("w", w - 1), ("n", n), ("s", s - 1))}
        west, south, east, north = sides
        weights = _halves(ids)
        for (x, kx), (y, ky), sign in (((west, "e"), (south, "n"), 1), ((west, "e"), (north, "s"), -1), ((east, "w"), (south, "n"), -1), ((east, "w"), (north, "s"), 1)):
            totals += sign * _under(ends[kx][0], ends[ky][0], x, y, weights, ends[kx][1], ends[ky][1])

    cols = [F.col(c).cast("long").alias(c) for c in ("way_id", "west", "south", "east", "north")]
    sides = boxes.select(*cols).dropna()
    ordered = _places(places, names, 2**40)
    made = _per_place(sides, ordered, names, 3, kernel, ROWS)
    return made.select(*names, "s0", _id_sum().alias("id_sum"))


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range, one after the other, and whose they are."""
    whose = np.repeat(np.arange(len(first)), size)
    return np.arange(len(whose)) + np.repeat(first - np.cumsum(size) + size, size), whose


class _Strips:
    """Points in strips of equal numbers by x, in each by y."""

    LEVELS = 1024

    def __init__(self, x: np.ndarray, y: np.ndarray):
        number = max(1, int(len(x) ** 0.5 * 0.8))
        cuts = np.unique(np.sort(x)[np.arange(number) * len(x) // number]) if len(x) else np.zeros(1)
        strip = np.searchsorted(cuts, x, "right") - 1
        order = np.lexsort((y, strip))
        self.ints = x[order], y[order]
        self.x, self.y = (c.astype(float) for c in self.ints)
        self.first = np.searchsorted(strip[order], np.arange(len(cuts)))
        self.west, self.east = cuts.astype(float), np.maximum.reduceat(self.x, self.first) if len(x) else cuts
        # Of each strip the first point at or above each level; levels are even between the outer hundredths, so few far points do no harm.
        self.low, high = np.quantile(self.y, [0.01, 0.99]) if len(x) else (0.0, 0.0)
        self.scale = self.LEVELS / (high - self.low + 1)
        self.table = np.searchsorted(strip[order] * self.LEVELS + self.level(self.y), np.arange(len(cuts) * self.LEVELS + 1))

    def level(self, y: np.ndarray) -> np.ndarray:
        return np.clip((y - self.low) * self.scale, 0, self.LEVELS - 1).astype(np.int64)

    def near(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Segments and points, by index, that may be as near as the reach of the point: those in the part of each strip that the segment runs through."""
        wide = np.maximum.reduceat(reach, self.first)
        low_x, high_x, low_y, high_y = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
        rounding = 1e-9 * (1 + max(np.abs(c).max() for c in (low_x, high_x, low_y, high_y)))
        start = np.searchsorted(np.maximum.accumulate(self.east + wide), low_x, "left")
        end = np.searchsorted(np.minimum.accumulate((self.west - wide)[::-1])[::-1], high_x, "right")
        at, k = _ranges(start, np.maximum(end - start, 0))
        # The part of the segment over the strip, and as far beside it as any of its points reaches.
        r = wide[at] + rounding
        west, east = np.maximum(self.west[at] - r, low_x[k]), np.minimum(self.east[at] + r, high_x[k])
        met = np.flatnonzero(west <= east)
        at, k, r, west, east = (c[met] for c in (at, k, r, west, east))
        with np.errstate(invalid="ignore", divide="ignore"):
            slope = np.where(x1 != x2, (y2 - y1) / (x2 - x1), 0.0)
        base = np.where(x1 != x2, y1 - slope * x1, 0.0)
        u, v = base[k] + slope[k] * west, base[k] + slope[k] * east
        steep = np.abs(slope)[k] * rounding + rounding
        upright = x1 == x2
        if upright.any():
            u, v = np.where(upright[k], low_y[k], u), np.where(upright[k], high_y[k], v)
        low, high = np.maximum(np.minimum(u, v) - steep, low_y[k]) - r, np.minimum(np.maximum(u, v) + steep, high_y[k]) + r
        first = self.table[at * self.LEVELS + self.level(low)]
        size = self.table[at * self.LEVELS + self.level(high) + 1] - first
        some = np.flatnonzero(size > 0)
        k, first, size = k[some], first[some], size[some]
        block = np.cumsum(size) // CELLS
        bounds = np.searchsorted(block, np.arange(block[-1] + 2)) if len(block) else [0]
        for a, b in zip(bounds, bounds[1:]):
            j, whose = _ranges(first[a:b], size[a:b])
            yield k[a:b][whose], j


def near_segments(points: DataFrame, segments: DataFrame, limit: int, cell: int) -> DataFrame:
    """px, py, way_id, seq, x1, y1, x2, y2: of each task's segments within limit of a point those that may be nearest to it.

    These are all whose squared distance is within NEAR of the least one; of equal segments only the first by way_id and seq.
    The reach of a point shrinks to its least distance so far, so most segments are told by the distance of their line.
    """
    columns = ["way_id", "seq", "x1", "y1", "x2", "y2"]
    places = _places(points, ["px", "py"], cell)

    def pruned(held: list, best: np.ndarray) -> list:
        """held without what is no longer near, and without repeats of a segment."""
        place, d2, *rest = (np.concatenate(c) for c in zip(*held))
        near = d2 <= best[place] + NEAR
        place, d2, rest = place[near], d2[near], [c[near] for c in rest]
        order = np.lexsort((rest[1], rest[0], *rest[2:], place))
        place, d2, rest = place[order], d2[order], [c[order] for c in rest]
        new = np.zeros(len(place), bool)
        new[:1] = True
        for c in (place, *rest[2:]):
            new[1:] |= c[1:] != c[:-1]
        return [(place[new], d2[new], *[c[new] for c in rest])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips = _Strips(*places.value.columns)
        best = np.full(len(strips.x), float(limit) ** 2)
        none = np.array([], np.int64)
        held = [(none, none.astype(float), *[none] * 6)]
        few = 500  # the first ones are few, as the reach is still wide
        for batch in _gathered(batches, 50_000):
            ints = [batch.column(i).to_numpy() for i in range(6)]
            first = 0
            while first < batch.num_rows and len(best):
                some = [c[first : first + few] for c in ints]
                first, few = first + few, min(2 * few, 2000)
                x1, y1, x2, y2 = (c.astype(float) for c in some[2:])
                dx, dy = x2 - x1, y2 - y1
                long2 = dx * dx + dy * dy
                length = np.sqrt(long2)
                reach = np.sqrt(best + NEAR) * (1 + 1e-9)
                for k, j in strips.near(x1, y1, x2, y2, reach):
                    across = np.abs((py := strips.y[j] - y1[k]) * (ux := dx[k]) - (px := strips.x[j] - x1[k]) * (uy := dy[k]))
                    fit = np.flatnonzero(across <= length[k] * reach[j] + 1e-6)
                    k, j, px, py, ux, uy = (c[fit] for c in (k, j, px, py, ux, uy))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        t = np.where(long2[k] > 0, np.clip((px * ux + py * uy) / long2[k], 0.0, 1.0), 0.0)
                    d2 = (px - t * ux) ** 2 + (py - t * uy) ** 2
                    np.minimum.at(best, j, d2)
                    fit = d2 <= best[j] + NEAR
                    held.append((j[fit], d2[fit], *[c[k[fit]] for c in some]))
            held = pruned(held, best)
        (place, _, *rest), = pruned(held, best)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (strips.ints[0][place], strips.ints[1][place], *rest)], names=["px", "py", *columns])

    rows = segments.select(*[F.col(c).cast("long").alias(c) for c in columns]).dropna()
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["px", "py", *columns]))
