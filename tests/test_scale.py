"""Operators that count without making pairs, against plain loops; each once failed on tables of 1 GB."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import arrangement, audit, build, closure, scan, tally


def test_spires_of_a_crowd_by_plain_loop(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(900), r.randrange(900), r.randrange(60)) for i in range(400)]
    rows += [rows[7], rows[7], rows[8], (9, 850, 20, 70), (10, 3, 3, 999), (500, 5000, 5000, 500), (501, 10, 10, None), (None, 10, 10, 5)]
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(500, 1), (10, 10), (501, 2)]
    top = {}
    for a, b in edges:
        for p, q in ((a, b), (b, a)):
            known = [h for s, _, _, h in rows if s == q and h is not None]
            if p != q and known:
                top[p] = max(known + [top.get(p, -1)])
    around = {}
    for s, x, y, _ in rows:
        around.setdefault(s, []).extend(h for t, u, v, h in rows if None not in (s, t, h) and s != t and abs(x // 300 - u // 300) <= 1 and abs(y // 300 - v // 300) <= 1)
    want = []
    for s, _, _, h in rows:
        if s in top and h is not None:
            own = sorted(around[s])
            rise = max([h - top[s]] + ([h - own[len(own) // 2]] if len(own) >= 8 else []))
            if rise >= 20:
                want.append((s, rise))
    frame = spark.createDataFrame(rows, "sector long, x long, y long, height long")
    got = audit.spires(frame, spark.createDataFrame(edges, "a long, b long"), 300, 20)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_spires_count_a_crowded_cell_without_pairs(spark):
    frame = spark.range(60_000).selectExpr("id AS sector", "id % 7 AS x", "id % 5 AS y", "id * 7919 % 400 AS height")  # 3.6 billion pairs
    got = audit.spires(frame, spark.createDataFrame([(3, 4), (59_999, 60_000)], "a long, b long"), 100, 1)
    heights = sorted(i * 7919 % 400 for i in range(60_000))
    h, top = 3 * 7919 % 400, 4 * 7919 % 400
    heights_of = lambda own: sorted(heights[: heights.index(own)] + heights[heights.index(own) + 1 :])[59_999 // 2]
    want = [(s, max(own - other, own - heights_of(own))) for s, own, other in ((3, h, top), (4, top, h))]
    assert sorted(map(tuple, got.collect())) == [w for w in want if w[1] >= 1]


def ways(r, n, span=3000):
    return [[(r.randrange(span), r.randrange(span)) for _ in range(r.randrange(2, 7))] for _ in range(n)]


def segments_of(spark, all_ways, closed=False):
    pairs = [(w, k, *p, *q) for w, line in enumerate(all_ways) for k, (p, q) in enumerate(zip(line, line[1:] + line[:1] if closed else line[1:]))]
    return spark.createDataFrame(pairs, "way_id long, seq long, x1 long, y1 long, x2 long, y2 long")


def boxes_and_odd_ones(spark, r, n):
    rows = [(i, x, y, x + r.randrange(200), y + r.randrange(200)) for i in range(n) for x, y in [(r.randrange(3000), r.randrange(3000))]]
    rows += [rows[3], (4, 0, 0, 400, 400), (n, 9000, 9000, 9001, 9001), (n + 1, None, 0, 5, 5), (n + 2, *rows[0][1:])]
    return rows, spark.createDataFrame(rows, "query_id long, q_west long, q_south long, q_east long, q_north long")


def test_ways_are_counted_at_boxes(spark):
    """Also boxes that are repeated, share an id, or hold a null; the pairs were rows before."""
    r = random.Random(3)
    _, boxes = boxes_and_odd_ones(spark, r, 120)
    segments = segments_of(spark, ways(r, 150) + [[(5, 5), (5, 5)], [(0, 0), (3000, 3000)]])
    want = scan.linework(boxes, segments, 500).groupBy("query_id").count().collect()
    got = scan.linework_counts(boxes, segments, 500)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 100


def test_boxes_are_counted_at_boxes(spark, monkeypatch):
    monkeypatch.setattr(tally, "ROWS", 100)
    r = random.Random(4)
    rows, boxes = boxes_and_odd_ones(spark, r, 150)
    found = [(2**40 * k - 7, x, y, x + r.randrange(900), y + r.randrange(900)) for k in range(600) for x, y in [(r.randrange(3000), r.randrange(3000))]]
    frame = spark.createDataFrame(found + [(1, None, 0, 9, 9)], "way_id long, west long, south long, east long, north long")
    want = {}
    for q, w, s, e, n in rows:
        ids = [k for k, *b in found if w is not None and b[0] <= e and b[2] >= w and b[1] <= n and b[3] >= s]
        if ids:
            want[q] = (want.get(q, (0, 0))[0] + len(ids), want.get(q, (0, 0))[1] + sum(ids))
    got = scan.candidate_counts(boxes, frame, 500)
    assert {k: (n, s) for k, n, s in got.collect()} == want


def test_rings_are_counted_at_points(spark):
    """Also rings that cross themselves, points on edges and corners, and ids that come twice or lie at two places."""
    r = random.Random(5)
    all_rings = ways(r, 200, 900) + [[(0, 0), (100, 0), (100, 100), (0, 100)]] * 3
    points = [(i, r.randrange(900), r.randrange(900)) for i in range(300)] + [(300, 0, 0), (301, 100, 50), (302, 50, 100), (303, 50, 0)]
    points += [points[0], points[1], points[1], (2, 450, 450), (304, None, 5)]
    frame, rings = spark.createDataFrame(points, "pt_id long, px long, py long"), segments_of(spark, all_rings, closed=True)
    want = scan.inside(frame, rings, 100).groupBy("pt_id").agg({"*": "count", "way_id": "sum"}).collect()
    want = sorted((x["pt_id"], x["count(1)"], x["sum(way_id)"]) for x in want)
    for cell in (100, 5000):
        assert sorted(map(tuple, scan.inside_counts(frame, rings, cell).collect())) == want and len(want) > 250


def test_coordinates_too_far_for_doubles(spark):
    far = 2**29 + 1
    segments = segments_of(spark, [[(0, 0), (far, far - 1)], [(0, 0), (3, far), (far, 3)]])
    boxes = spark.createDataFrame([(1, far - 1, far - 1, far, far - 1), (2, far - 1, far - 2, far, far - 2), (3, 1, 1, 1, 1)], "query_id long, q_west long, q_south long, q_east long, q_north long")
    want = scan.linework(boxes, segments, 2**28).groupBy("query_id").count().collect()
    assert sorted(map(tuple, scan.linework_counts(boxes, segments, 2**28).collect())) == sorted(map(tuple, want))


def test_nearest_segment_by_plain_loop(spark):
    r = random.Random(6)
    lines = ways(r, 60, 800) + [[(10, 10), (10, 10)], [(700, 700), (790, 700)], [(700, 700), (790, 700)]]
    points = [(i, r.randrange(900), r.randrange(900)) for i in range(150)] + [(150, 720, 705), (0, 720, 705), (151, 5000, 5000), (152, 10, 11)]
    want = {}
    for p, px, py in points:
        for w, line in enumerate(lines):
            for k, ((a, b), (c, d)) in enumerate(zip(line, line[1:])):
                dx, dy = c - a, d - b
                t = max(0.0, min(1.0, ((px - a) * dx + (py - b) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                d2, side = (px - a - t * dx) ** 2 + (py - b - t * dy) ** 2, dx * (py - b) - dy * (px - a)
                if d2 <= 60 * 60:
                    want[p] = min(want.get(p, (1e9,)), (round(d2, 6), w, k, (side > 0) - (side < 0)))
    got = scan.side_of_line(spark.createDataFrame(points, "pt_id long, px long, py long"), segments_of(spark, lines).repartition(3), 60)
    assert sorted(map(tuple, got.collect())) == sorted((p, w, s) for p, (_, w, _, s) in want.items()) and len(want) > 100


def test_segments_meet_only_the_points_of_strips_that_they_run_through():
    """No pair within reach is lost, also of upright segments, far points and points in a line; before, each segment was held against blocks of all points."""
    r = np.random.default_rng(8)
    far = np.array([[-(10**7), 10**7], [10**7, 3], [450, -(10**8)]])
    ends = r.integers(0, 1000, (4, 300))
    ends[2, :20], ends[3, 20:40], ends[:2, 40:50] = ends[0, :20], ends[1, 20:40], ends[2:, 40:50]
    for points, wide in ((r.integers(0, 1000, (900, 2)), 3), (np.concatenate([r.integers(0, 1000, (600, 2)), far]), 40), (np.stack([np.full(300, 500), np.arange(300) * 3], 1), 2), (np.array([[500, 500]]), 90)):
        strips = tally._Strips(*np.unique(points, axis=0).T)
        reach = r.uniform(0, wide, len(strips.x))
        reach[:2] = 300
        x1, y1, x2, y2 = ends.astype(float)
        pairs = [(k, j) for a, b in strips.near(x1, y1, x2, y2, reach) for k, j in zip(a.tolist(), b.tolist())]
        dx, dy = (x2 - x1)[:, None], (y2 - y1)[:, None]
        long2 = np.where((dx == 0) & (dy == 0), 1, dx * dx + dy * dy)
        t = np.clip(((strips.x - x1[:, None]) * dx + (strips.y - y1[:, None]) * dy) / long2, 0, 1)
        near = np.hypot(strips.x - x1[:, None] - t * dx, strips.y - y1[:, None] - t * dy) <= reach
        assert set(zip(*(i.tolist() for i in np.nonzero(near)))) <= set(pairs) and len(set(pairs)) == len(pairs)
        if len(points) > 300:
            assert len(pairs) < near.size / 2


def test_owned_areas_without_faces(spark, monkeypatch):
    """Of outlines along the axes, also bent ones and those that touch, no face is made; of slanted ones the faces tell."""
    r = random.Random(7)
    bent = [(0, 0), (60, 0), (60, 20), (20, 20), (20, 60), (0, 60)]
    box = lambda: (sorted(r.sample(range(50), 2)), sorted(r.sample(range(50), 2)))
    tiles = [[[(x[0], y[0]), (x[1], y[0]), (x[1], y[1]), (x[0], y[1])][:: r.choice((1, -1))] for x, y in (box() for _ in range(k))] for k in range(1, 9)]
    tiles += [[bent, [(10, 10), (40, 10), (40, 40), (10, 40)]], [[(10, 10), (40, 10), (40, 40), (10, 40)], bent], [[(0, 0), (9, 0), (9, 9), (0, 9)]] * 2]
    slanted = [[(0, 0), (100, 0), (100, 100), (0, 100)], [(0, 0), (50, 20), (20, 50)], [(10, 0), (10, 60), (40, 30)]]
    want = []
    for rings in [*tiles, slanted]:
        total = {}
        for owner, area, _ in arrangement._outlined(rings):
            if owner >= 0:
                total[owner] = total.get(owner, 0.0) + area
        want.append(total)
    assert [arrangement.owned(rings) for rings in [*tiles, slanted]] == want
    monkeypatch.setattr(arrangement, "bounded", None)
    assert [arrangement.owned(rings) for rings in tiles] == want[:-1]
    rows = [(t, k, f"l{k % 3}", [(float(x) + 5, float(y)) for x, y in ring]) for t, rings in enumerate(tiles) for k, ring in enumerate(rings)]
    frame = spark.createDataFrame(rows, "tile long, spec long, layer string, points array<struct<x:double,y:double>>")
    got = arrangement.owned_areas(frame, (5, 0)).groupBy("tile", "layer").sum("area").collect()
    sums = {}
    for t, total in enumerate(want[:-1]):
        for k, a in total.items():
            sums[t, f"l{k % 3}"] = sums.get((t, f"l{k % 3}"), 0.0) + a
    assert {(t, n): a for t, n, a in got} == sums


def flat(tiles):
    corners = np.array([p for rings in tiles for ring in rings for p in ring])
    return corners[:, 0], corners[:, 1], np.cumsum([len(ring) for rings in tiles for ring in rings]), np.cumsum([len(rings) for rings in tiles])


def test_faces_of_many_tiles_are_closed_without_walks(monkeypatch):
    """Numbers of faces, open corners and one-sided lines as by the walk around each face, also of bent outlines, spikes and holes; before, each tile was walked."""
    r, (w, h) = random.Random(9), (60, 50)
    box = lambda x, y: [(x[0], y[0]), (x[1], y[0]), (x[1], y[1]), (x[0], y[1])]
    some = lambda: box(sorted(r.sample(range(w + 1), 2)), sorted(r.sample(range(h + 1), 2)))[:: r.choice((1, -1))]
    bent, spike = [(0, 0), (60, 0), (60, 20), (20, 20), (20, 40), (0, 40)], [(10, 10), (30, 10), (30, 30), (30, 10), (40, 10), (40, 45), (10, 45), (10, 45)]
    plain = [[*[some() for _ in range(k % 12)], *[bent] * (k % 3 == 0), *[spike] * (k % 5 == 0)] for k in range(90)]
    plain = [[*rings[:2], box((0, w), (0, h)), *rings[2:]] for rings in plain] + [[box((0, w), (0, h)), box((10, 50), (10, 40)), box((20, 30), (20, 30))]]
    others = [[box((0, w), (0, h)), [(0, 0), (50, 20), (20, 50)]], [box((5, 20), (5, 20)), box((30, 40), (0, 9))], [box((0, w), (0, h)), box((-3, 9), (5, 9))]]
    walked = lambda rings: closure.of_faces([(owner >= 0, edges) for owner, _, edges in arrangement._outlined(rings)], (w, h))
    monkeypatch.setattr(closure, "CELLS", 5000)
    assert closure._closed(*flat(plain[:40] + others + plain[40:]), (w, h)).T.tolist() == [list(map(int, walked(rings))) for rings in plain[:40] + others + plain[40:]]
    monkeypatch.setattr(closure, "COORDINATES", 10)
    assert closure._closed(*flat(plain), (w, h)).T.tolist() == [list(map(int, walked(rings))) for rings in plain]
    monkeypatch.setattr(closure, "COORDINATES", 170)
    monkeypatch.setattr(arrangement, "bounded", None)
    found = closure._closed(*flat(plain), (w, h))
    assert found[0].max() > 20 and found[0, -1] == 3


def test_open_faces_are_told():
    whole = [(0, 0, 9, 0), (9, 0, 9, 9), (9, 9, 0, 9), (0, 9, 0, 0)]
    inner = [(2, 2, 4, 2), (4, 2, 4, 4), (4, 4, 2, 2)]
    assert closure.of_faces([(True, whole)], (9, 9)) == (1, 0, 4, 0, True)
    assert closure.of_faces([(True, whole[:3])], (9, 9)) == (1, 2, 3, 0, True)
    assert closure.of_faces([(True, whole), (True, inner)], (9, 9)) == (2, 0, 4, 3, True)
    assert closure.of_faces([(True, whole), (False, inner)], (9, 9)) == (2, 0, 4, 0, True)
    assert closure.of_faces([(True, inner), (True, [e[2:] + e[:2] for e in inner])], (9, 9)) == (2, 0, 0, 0, False)


def test_closed_tiles_as_by_sectors_and_lines(spark):
    """The same as from the rows of all edges and lines, with outlines along the axes and slanted ones."""
    r = random.Random(10)
    rows = []
    for i in range(40):
        x, y = (sorted(r.sample(range(-9, 50), 2)) for _ in range(2))
        ring = [(x[0], y[0]), (x[1], y[0]), (x[1], y[1]), (x[0], y[1])] if i % 8 else [(x[0], y[0]), (x[1], y[0]), (x[1], y[1])]
        rows.append((i % 5, i, r.choice(("water", "landuse", "buildings")), [tuple(map(float, p)) for p in [*ring, ring[0]]], None, None))
    frame = spark.createDataFrame(rows, "tile long, osm_id long, bucket string, points array<struct<x:double,y:double>>, width_m double, bridge string")
    made = build.build(frame, (0, 0, 40, 40), {k: (0, 9, k) for k in build.LAYERS})
    open_ = audit.open_sectors(made.uses.withColumn("sector", F.struct("tile", "face")), "sector").groupBy(F.col("sector.tile").alias("tile")).agg(F.sum("odd_vertices").alias("n"))
    same = lambda c, bound: (F.col(f"p.{c}") == bound) & (F.col(f"q.{c}") == bound)
    side = F.when(same("x", 0), 0).when(same("x", 40), 1).when(same("y", 0), 2).when(same("y", 40), 3)
    walls = made.lines.where("blocking").groupBy("tile").agg(F.countDistinct(side).alias("sides"), F.count_if(F.col("special").isNull()).alias("inner"))
    faces = made.sectors().groupBy("tile").agg(F.count("*").alias("faces"))
    want = walls.join(faces, "tile").join(open_, "tile", "left").select("tile", "faces", F.coalesce("n", F.lit(0)), "sides", "inner")
    assert sorted(map(tuple, made.closed.collect())) == sorted(map(tuple, want.collect()))
