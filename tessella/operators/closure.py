"""Whether the faces of tiles are closed: corners that an odd number of a face's edges meet, and lines with one side.

Every face of every tile is made. Where all outlines of a tile run along the axes and one of them is the whole tile, its
faces are told apart on the grid of its coordinates, for many tiles at once; else by the walk around each face.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import arrangement

#: Cells of the grids that are looked at together; coordinates of a tile at most (labels have 16 bits).
CELLS, COORDINATES = 400_000, 170
#: Lines this near to a side of the tile are on its border (as in faces.on_border).
TOLERANCE = 1


def of_faces(faces: list[tuple[bool, list[tuple]]], size: tuple[int, int]) -> tuple[int, int, int, int, int]:
    """Faces, open corners, sides of the tile with one-sided lines, one-sided lines beside the border, and whether there is a one-sided line.

    faces: whether a polygon owns the face, and its directed edges x1, y1, x2, y2, as in arrangement.outlines(). Lines as in faces.lines().
    """
    open_corners, uses = 0, {}
    for number, (_, edges) in enumerate(faces):
        odd: set = set()
        for e in edges:
            odd ^= {e[:2]}
            odd ^= {e[2:]}
            uses.setdefault((min(e[:2], e[2:]), max(e[:2], e[2:])), []).append(number)
        open_corners += len(odd)
    sides, inner, one_sided = set(), 0, False
    for (p, q), of in uses.items():
        if len(of) == 1 and faces[of[0]][0]:
            one_sided = True
            at = [(k, bound) for k in (0, 1) for bound in (0, size[k])]
            sides.update([next((s for s, (k, bound) in enumerate(at) if p[k] == bound == q[k]), None)])
            inner += not any(abs(p[k] - bound) <= TOLERANCE and abs(q[k] - bound) <= TOLERANCE for k, bound in at)
    return len(faces), open_corners, len(sides - {None}), inner, one_sided


def _spread(labels: np.ndarray, beside: np.ndarray, below: np.ndarray) -> None:
    """Gives connected cells the least of their labels. Axes: x, y, tile; beside and below: open to the next cell along x, y."""
    top = np.iinfo(labels.dtype).max
    shut = [(m ^ True).astype(labels.dtype) * top for m in (beside, below)]
    before = None
    while before is None or not np.array_equal(before, labels):
        before = labels.copy()
        for n, wall, at in ((len(labels), shut[0], lambda a, i: a[i]), (labels.shape[1], shut[1], lambda a, i: a[:, i])):
            for i in range(1, n):
                np.minimum(at(labels, i), at(labels, i - 1) | at(wall, i - 1), out=at(labels, i))
            for i in range(n - 2, -1, -1):
                np.minimum(at(labels, i), at(labels, i + 1) | at(wall, i), out=at(labels, i))


def of_grids(nx: int, ny: int, edges: list[np.ndarray], tiles: int) -> tuple[np.ndarray, ...]:
    """Per tile: faces, open corners, whether each side (west, east, south, north) has one-sided lines, and one-sided lines elsewhere.

    edges: tile, i1, j1, i2, j2 of the edges along the axes, as places in the tile's sorted coordinates; the first and last
    ones of each tile are its frame. nx, ny: most coordinates of a tile.
    """
    t, i1, j1, i2, j2 = edges
    left, right, down, up = np.minimum(i1, i2), np.maximum(i1, i2), np.minimum(j1, j2), np.maximum(j1, j2)
    level = j1 == j2

    def drawn(some, first, last, axis):
        marks = np.zeros((nx, ny, tiles), np.int16)
        np.add.at(marks, (first[0][some], first[1][some], t[some]), 1)
        np.add.at(marks, (last[0][some], last[1][some], t[some]), -1)
        return np.cumsum(marks, axis, dtype=np.int16) > 0

    # An edge from the place to the next one along x, and along y.
    along, upright = drawn(level, (left, j1), (right, j1), 0), drawn(~level, (i1, down), (i1, up), 1)
    ends = np.zeros((nx, ny, tiles), bool)
    ends[i1, j1, t] = ends[i2, j2, t] = True
    # A cell lies above and right of its place; those around the frame, and what follows it, have label 0.
    label = np.zeros((nx + 1, ny + 1, tiles), np.int16)
    label[1:-1, 1:-1] = (1 + np.arange((nx - 1) * (ny - 1), dtype=np.int16)).reshape(nx - 1, ny - 1, 1)
    last_x, last_y = np.zeros(tiles, np.int64), np.zeros(tiles, np.int64)
    np.maximum.at(last_x, t, right)
    np.maximum.at(last_y, t, up)
    label *= (np.arange(nx + 1)[:, None, None] <= last_x) & (np.arange(ny + 1)[:, None] <= last_y)
    own = label.copy()
    beside, below = np.ones((nx, ny + 1, tiles), bool), np.ones((nx + 1, ny, tiles), bool)
    beside[:, 1:-1], below[1:-1] = ~upright[:, :-1], ~along[:-1]
    _spread(label, beside, below)
    faces = ((label == own) & (own > 0)).sum((0, 1))
    # Around each place: the cells, and the parity of each cell's edges there.
    ne, nw, sw, se = label[1:, 1:], label[:-1, 1:], label[:-1, :-1], label[1:, :-1]
    e, n = along, upright
    w, s = np.zeros_like(e), np.zeros_like(n)
    w[1:], s[:, 1:] = along[:-1], upright[:, :-1]
    cells, odd = (ne, nw, sw, se), (e ^ n, n ^ w, w ^ s, s ^ e)
    same = {(a, b): cells[a] == cells[b] for a in range(4) for b in range(a + 1, 4)}
    open_corners = np.zeros(tiles, np.int64)
    for a in range(4):
        parity, seen = odd[a].copy(), cells[a] == 0
        for b in range(4):
            if b != a:
                parity ^= odd[b] & same[min(a, b), max(a, b)]
            if b < a:
                seen |= same[b, a]
        open_corners += (parity & ~seen).sum((0, 1))
    # Lines run from corner to corner: where an edge ends, or edges of both directions meet.
    corner = ends | ((e | w) & (n | s))
    one_level, one_upright = along & ((ne == 0) ^ (se == 0)), upright & ((ne == 0) ^ (nw == 0))
    on = np.arange(tiles)
    sides = [one_upright[0].any(0), one_upright[last_x, :, on].any(1), one_level[:, 0].any(0), one_level[:, last_y, on].any(0)]
    one_upright[0], one_level[:, 0] = False, False
    one_upright[last_x, :, on], one_level[:, last_y, on] = False, False
    return faces, open_corners, np.array(sides), ((one_level & corner).sum((0, 1)) + (one_upright & corner).sum((0, 1)))


def _ranks(tile: np.ndarray, value: np.ndarray, tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value among the distinct ones of its tile, and how many its tile has; tiles are 0, 1, ..., in order."""
    low = value.min()
    known, at = np.unique(tile * (value.max() - low + 1) + (value - low), return_inverse=True)
    first = np.searchsorted(known // (value.max() - low + 1), np.arange(tiles + 1))
    return at - first[tile], np.diff(first)


def _closed(x: np.ndarray, y: np.ndarray, ring_ends: np.ndarray, tile_ends: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """of_faces() of each tile, from the corners of its rings; tile_ends: numbers of rings."""
    out = np.zeros((5, len(tile_ends)), np.int64)
    ring_first, tile_first = np.append(0, ring_ends[:-1]), np.append(0, tile_ends[:-1])
    ring = np.repeat(np.arange(len(ring_ends)), ring_ends - ring_first)
    tile_of_ring = np.repeat(np.arange(len(tile_ends)), tile_ends - tile_first)
    tile = tile_of_ring[ring]
    after = np.arange(1, len(x) + 1)
    some = ring_ends > ring_first
    after[ring_ends[some] - 1] = ring_first[some]
    x2, y2 = x[after], y[after]
    plain = np.ones(len(tile_ends), bool)
    plain[tile[(x != x2) & (y != y2)]] = False
    # One ring is the whole tile: four corners, each in another corner of the box, and nothing lies beyond.
    code = np.where(((x == 0) | (x == size[0])) & ((y == 0) | (y == size[1])), 1 << ((x > 0) + 2 * (y > 0)), 0)
    whole = (ring_ends - ring_first == 4) & (np.bincount(ring, code, len(ring_ends)) == 15) & (np.bincount(ring, code == 0, len(ring_ends)) == 0)
    plain &= np.bincount(tile_of_ring, whole, len(tile_ends)) > 0
    plain[tile[(x < 0) | (x > size[0]) | (y < 0) | (y > size[1])]] = False
    edge = np.flatnonzero(plain[tile] & ((x != x2) | (y != y2)))
    if len(edge):
        (i, nx), (j, ny) = _ranks(tile, x, len(tile_ends)), _ranks(tile, y, len(tile_ends))
        plain &= np.maximum(nx, ny) <= COORDINATES
        edge = edge[plain[tile[edge]]]
        # Tiles of about as many coordinates together.
        order = np.flatnonzero(plain)[np.lexsort((ny[plain], nx[plain]))]
        first, end = np.searchsorted(tile[edge], order), np.searchsorted(tile[edge], order, "right")
        a = 0
        while a < len(order):
            b = min(len(order), a + max(1, CELLS // int(nx[order[a]] * ny[order[a]])))
            b = a + int(np.searchsorted(nx[order[a:b]], nx[order[a]] + 2, "right"))
            most_x, most_y = int(nx[order[a:b]].max()), int(ny[order[a:b]].max())
            sizes = end[a:b] - first[a:b]
            whose = np.repeat(np.arange(b - a), sizes)
            at = edge[np.arange(len(whose)) + np.repeat(first[a:b] - np.cumsum(sizes) + sizes, sizes)]
            faces, corners, sides, inner = of_grids(most_x, most_y, [whose, i[at], j[at], i[after[at]], j[after[at]]], b - a)
            out[:, order[a:b]] = np.stack([faces, corners, sides.sum(0), inner, sides.any(0)])
            a = b
    for k in np.flatnonzero(~plain).tolist():
        rings = [list(zip(x[a:b].tolist(), y[a:b].tolist())) for a, b in zip(ring_first[tile_first[k] : tile_ends[k]].tolist(), ring_ends[tile_first[k] : tile_ends[k]].tolist())]
        out[:, k] = of_faces([(owner >= 0, edges) for owner, _, edges in arrangement._outlined(rings)], size)
    return out


def closed(polygons: DataFrame, low: tuple[float, float], size: tuple[int, int], units: int = 1, tile: str = "tile") -> DataFrame:
    """tile, faces, open_corners, border_sides, inner_walls of tiles with a one-sided line. polygons: tile, points (array of x, y).

    open_corners: corners of faces that an odd number of edge ends meet; border_sides: how many sides of the tile have
    one-sided lines; inner_walls: one-sided lines that are not on the border.
    """
    schema = f"{tile} long, faces long, open_corners long, border_sides long, inner_walls long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            points = lists.flatten()
            corners = points.flatten()
            x, y = (np.rint((corners.field(k).to_numpy(zero_copy_only=False) - low[k]) * units).astype(np.int64) for k in (0, 1))
            ring_ends, tile_ends = (np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False)) for c in (points, lists))
            found = _closed(x, y, ring_ends, tile_ends, size)
            known = found[4] > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(known)), *[pa.array(c[known]) for c in found[:4]]], names=[c.split()[0] for c in schema.split(", ")])

    return polygons.groupBy(tile).agg(F.collect_list("points").alias("polygons")).mapInArrow(run, schema)
