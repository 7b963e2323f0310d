"""Further queries over the driver's tables: sources, summaries, terrain and faces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry, grid, tags
from tessella.operators import arrangement, audit, build, faces, graph, placement, polygons, raster, rollup, scan, sequence, telemetry
from tessella.plans.catalogue import _BOX, _BOXED, _RECTANGLES, _outlines, query
from tessella.plans.views import sql
from tessella.sources import archives, elements

# --- sources --------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN n = d THEN d ELSE CONCAT_WS(', ', n, d) END AS name FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'Ward ' || c_custkey % 3 ELSE c_mktsegment END AS n,
    CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'District ' || c_custkey % 11 END AS d FROM customer)""")
def place_names(v):
    parish = F.expr("CASE WHEN c_custkey % 5 = 0 THEN concat(c_mktsegment, ', Unparished area') WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END")
    district = F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE concat('District ', c_custkey % 11) END")
    return v.table("customer").select("c_custkey", elements.place_name(parish, F.expr("concat('Ward ', c_custkey % 3)"), district).alias("name"))


@query("""SELECT c_custkey, '(way["building"](' || b || ');way["natural"="coastline"](' || b || ');)' AS text FROM (SELECT c_custkey, PRINTF('%.6f', 50 + c_custkey / 7.0) || ',' || PRINTF('%.6f', c_custkey / 11.0 - 50) || ',' || PRINTF('%.6f', 51 + c_custkey / 7.0) || ',' || PRINTF('%.6f', c_custkey / 11.0 - 49) AS b FROM customer)""")
def bounds_texts(v):
    """Queries of two selectors, their bounds rounded to six places."""
    south, west = 50 + F.col("c_custkey") / 7.0, F.col("c_custkey") / 11.0 - 50
    return v.table("customer").select("c_custkey", elements.query_text(['way["building"]', 'way["natural"="coastline"]'], south, west, south + 1, west + 1).alias("text"))


@query("SELECT o_orderkey, o_orderkey % 4 = 1 AS done, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 97 END AS sectors FROM orders")
def artifacts_done(v):
    """Text that is missing, broken or no object is not done."""
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('{\"tile\": ', o_orderkey, ', \"sectors\": ', o_orderkey % 97, '}') WHEN 2 THEN concat('{\"tile\": ', o_orderkey, ', \"sec') ELSE 'none' END")
    read = rollup.read_meta(v.table("orders").select("o_orderkey", text.alias("value")), "tile long, sectors long")
    return read.select("o_orderkey", "done", F.when(F.col("done"), F.col("meta.sectors")).alias("sectors"))


@query("SELECT c_nationkey AS folder, path, size FROM (SELECT c_nationkey, c_name AS path, c_custkey % 13 AS size, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 13 DESC, c_name) AS r FROM customer) WHERE r = 1")
def widest_files(v):
    return rollup.widest_file(v.table("customer").selectExpr("c_nationkey AS folder", "c_name AS path", "c_custkey % 13 AS size"), "folder")


_OUTCOME = "CASE WHEN o_orderkey % 9 = 0 THEN 'MISSING' WHEN o_orderkey % 6 >= 4 THEN 'FAILED after ' || o_orderkey % 6 WHEN o_orderkey % 5 = 0 THEN 'BAD ZIP' WHEN o_orderkey % 5 = 1 THEN 'METADATA-ONLY' ELSE 'OK' END"


def _fetched(v):
    status, members = F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 404 ELSE 200 END"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END")
    return v.table("orders").select("o_orderkey", F.expr("o_custkey % 25 AS region"), rollup.outcome(status, members, F.expr("o_orderkey % 6")).alias("outcome"))


@query(f"SELECT o_orderkey, {_OUTCOME} AS outcome FROM orders")
def mirror_outcomes(v):
    return _fetched(v).select("o_orderkey", "outcome")


@query(f"SELECT o_custkey % 25 AS region, COUNT(*) AS rows, COUNT(*) FILTER ({_OUTCOME} <> 'OK') AS failed FROM orders GROUP BY 1")
def fetch_failures(v):
    return rollup.failures(_fetched(v), "region")


@query("SELECT o_custkey % 25 AS region, COUNT(*) FILTER (o_orderkey % 3 = 0) AS local, COUNT(*) FILTER (o_orderkey % 3 <> 0) AS network, COUNT(DISTINCT o_orderpriority) AS sources FROM orders GROUP BY 1")
def source_tallies(v):
    return rollup.tallies(v.table("orders").selectExpr("o_custkey % 25 AS region", "o_orderkey % 3 = 0 AS local", "o_orderpriority AS source"), "region")


@query("SELECT p.region, p.square FROM (SELECT DISTINCT o_custkey % 25 AS region, o_orderkey % 40 AS square FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 25 = p.region AND s_suppkey % 40 = p.square)")
def uncovered_squares(v):
    """Squares that scans want and the index does not hold."""
    wanted = v.table("orders").selectExpr("o_custkey % 25 AS region", "o_orderkey % 40 AS square").distinct()
    return rollup.uncovered(wanted, v.table("supplier").selectExpr("s_suppkey % 25 AS region", "s_suppkey % 40 AS square"), ["region", "square"])


@query("SELECT pack, member, data FROM (SELECT o_custkey % 40 AS pack, 'm' || o_orderkey % 30 AS member, MAX(o_orderkey) AS data FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) UNION ALL SELECT pack, member, data FROM (SELECT o_custkey % 40 AS pack, 'm' || o_orderkey % 30 AS member, MAX(-o_orderkey) AS data FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 40 = x.pack AND 'm' || o_orderkey % 30 = x.member)")
def merged_members(v):
    """Files of two layers; the second layer's win."""
    rows = v.table("orders").selectExpr("o_custkey % 40 AS pack", "concat('m', o_orderkey % 30) AS member", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE -o_orderkey END AS data", "o_orderstatus = 'F' AS later")
    layer = lambda later: rows.where(F.col("later") == later).groupBy("pack", "member").agg(F.max("data").alias("data"))
    return archives.last_members(layer(False), layer(True))


@query(sql("pack_member", "SELECT pack, COUNT(*) AS rest FROM pack_member m WHERE NOT EXISTS (SELECT 1 FROM (SELECT member, sig FROM pack_member GROUP BY member, sig HAVING COUNT(*) = (SELECT COUNT(DISTINCT pack) FROM pack_member)) c WHERE c.member = m.member AND c.sig = m.sig) GROUP BY pack"))
def pack_rests(v):
    """How many members stay in each pack once the common ones are moved out."""
    return rollup.pack_rest(v.pack_member()).groupBy("pack").agg(F.count("*").alias("rest"))


# --- texts ----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, 'MM' || CASE WHEN c_custkey < 10 THEN '0' ELSE '' END || c_custkey AS lump FROM customer")
def minimap_lumps(v):
    return v.table("customer").select("c_custkey", grid.lump_name("MM", F.col("c_custkey") - 1).alias("lump"))


@query("SELECT c_custkey, PRINTF('%.5f', ABS(c_custkey / 8.0 - 60)) || CASE WHEN c_custkey / 8.0 - 60 >= 0 THEN 'N' ELSE 'S' END AS lat FROM customer")
def hemispheres(v):
    return v.table("customer").select("c_custkey", grid.degrees_text(F.col("c_custkey") / 8.0 - 60, "N", "S").alias("lat"))


@query(sql("telemetry", "SELECT event_id, 'MAP' || LPAD(CAST(user_id % 90 + 10 AS VARCHAR), 2, '0') AS map, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(-(event_id % 50) AS DOUBLE) AS z, CAST(ang AS DOUBLE) AS ang FROM telemetry"))
def telemetry_lines(v):
    """Lines of the console log, written and read back."""
    line = F.expr("concat('P2W TLM map=MAP', user_id % 90 + 10, ' x=', x, ' y=', y, ' z=', -(event_id % 50), ' lat=51.5 lng=1.25 ang=', ang, ' fwd=1 side=0 spd=2.5')")
    fields = telemetry.parse_line(F.col("line"))
    return v.telemetry().select("event_id", line.alias("line")).select("event_id", *[fields[k] for k in ("map", "x", "y", "z", "ang")])


@query(sql("telemetry", "SELECT event_id FROM telemetry WHERE event_id % 10 = 0 AND (pushing OR event_id % 7 / 4.0 >= 0.5)"))
def throttled_ticks(v):
    return telemetry.throttled(v.telemetry().selectExpr("event_id AS tick", "pushing", "event_id % 7 / 4D AS speed")).select(F.col("tick").alias("event_id"))


# --- summaries ------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey % 40 AS tile, COUNT(*) FILTER (o_orderkey % 4 = 0) AS roads, COUNT(*) FILTER (o_orderkey % 4 = 1) AS buildings, COUNT(*) FILTER (o_orderkey % 4 = 2) AS water FROM orders GROUP BY 1")
def build_counts(v):
    specs = v.table("orders").selectExpr("o_custkey % 40 AS tile", "CASE o_orderkey % 4 WHEN 0 THEN 'roads' WHEN 1 THEN 'buildings' WHEN 2 THEN 'water' ELSE 'trees' END AS layer")
    return rollup.layer_counts(specs, "tile", ["roads", "buildings", "water"])


@query("SELECT region, n, done, ROUND(spent * (total - done) / done, 6) AS eta FROM (SELECT o_custkey % 25 AS region, o_orderkey AS n, ROW_NUMBER() OVER w AS done, CAST(SUM(o_orderkey % 60) OVER w AS DOUBLE) AS spent, COUNT(*) OVER (PARTITION BY o_custkey % 25) AS total FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) WINDOW w AS (PARTITION BY o_custkey % 25 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))")
def build_eta(v):
    log = v.table("orders").select("o_custkey", "o_orderkey").distinct().selectExpr("o_custkey % 25 AS region", "o_orderkey AS n", "CAST(o_orderkey % 60 AS DOUBLE) AS spent")
    totals = log.groupBy("region").agg(F.count("*").alias("total"))
    return rollup.eta(log.join(totals, "region"), "region", "n", "spent", "total").select("region", "n", "done", F.round("eta", 6).alias("eta"))


@query(f"""WITH r AS ({_RECTANGLES}), xs AS (SELECT tile, x, LEAD(x) OVER (PARTITION BY tile ORDER BY x) AS x2 FROM (SELECT tile, x1 AS x FROM r UNION SELECT tile, x2 FROM r)),
    ys AS (SELECT tile, y, LEAD(y) OVER (PARTITION BY tile ORDER BY y) AS y2 FROM (SELECT tile, y1 AS y FROM r UNION SELECT tile, y2 FROM r)),
    c AS (SELECT xs.tile, (xs.x2 - xs.x) * (ys.y2 - ys.y) AS a, MAX(r.spec) AS spec FROM xs JOIN ys ON ys.tile = xs.tile JOIN r ON r.tile = xs.tile AND r.x1 <= xs.x AND r.x2 >= xs.x2 AND r.y1 <= ys.y AND r.y2 >= ys.y2 GROUP BY xs.tile, xs.x, ys.y, xs.x2, ys.y2),
    s AS (SELECT tile, CASE spec % 3 WHEN 0 THEN 'farm' WHEN 1 THEN 'wood' ELSE 'paved' END AS cover, CAST(SUM(a) AS DOUBLE) AS area FROM c GROUP BY 1, 2)
    SELECT tile, cover, area, ROUND_EVEN(area * 100.0 / SUM(area) OVER (PARTITION BY tile), 1) AS pct FROM s""")
def cover_percents(v):
    """Land cover of each tile by what its arrangement shows."""
    boxes = v.table("orders").selectExpr("o_custkey AS tile", "o_orderkey AS spec", "(o_orderkey * 37) % 200 AS x1", "(o_orderkey * 91) % 200 AS y1", "(o_orderkey * 37) % 200 + 10 + o_orderkey % 83 AS x2", "(o_orderkey * 91) % 200 + 10 + o_orderkey % 71 AS y2")
    corners = F.posexplode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in _BOX])).alias("seq", "p")
    shown = arrangement.arrange(boxes.select("tile", "spec", corners).select("tile", "spec", "seq", "p.x", "p.y")).where("spec IS NOT NULL")
    cover = F.expr("CASE spec % 3 WHEN 0 THEN 'farm' WHEN 1 THEN 'wood' ELSE 'paved' END")
    return rollup.cover_percent(shown.select("tile", cover.alias("cover"), "area"), "tile", "cover")


@query("SELECT region, cover, share FROM (SELECT o_custkey % 25 AS region, o_orderpriority AS cover, CAST(COUNT(*) % 3 AS DOUBLE) / 2 AS share FROM orders GROUP BY 1, 2) WHERE share > 0.5")
def trimmed_covers(v):
    shares = v.table("orders").groupBy(F.expr("o_custkey % 25 AS region"), F.col("o_orderpriority").alias("cover")).agg((F.count("*") % 3 / 2.0).alias("share"))
    maps = shares.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("cover", "share"))).alias("shares"))
    return maps.select("region", F.explode(tags.trimmed(F.col("shares"))).alias("cover", "share"))


# --- rasters --------------------------------------------------------------------------------------------------------


@query(sql("pixel", """+ q AS (SELECT s_suppkey AS box, s_suppkey % 10 AS tile_no, s_suppkey % 30 AS row0, s_suppkey % 30 + 8 AS row1, s_suppkey * 7 % 30 AS col0, s_suppkey * 7 % 30 + 9 AS col1 FROM supplier)
    SELECT box, MIN(dtm) AS low, MAX(dtm) AS high, ROUND(AVG(dtm), 6) AS mean, COUNT(dtm) AS cells FROM q JOIN pixel ON pixel.tile_no = q.tile_no AND prow BETWEEN row0 AND row1 AND pcol BETWEEN col0 AND col1 GROUP BY box"""))
def window_stats(v):
    boxes = v.table("supplier").selectExpr("s_suppkey AS box", "s_suppkey % 10 AS tile_no", "s_suppkey % 30 AS row0", "s_suppkey % 30 + 8 AS row1", "s_suppkey * 7 % 30 AS col0", "s_suppkey * 7 % 30 + 9 AS col1")
    return raster.window(v.pixel(), boxes, "box").withColumn("mean", F.round("mean", 6))


@query(sql("pixel", """+ r AS (SELECT o_orderkey AS way_id, o_custkey % 10 AS tile_no, o_orderkey % 37 AS x1, o_orderkey * 7 % 37 AS y1, o_orderkey % 37 + o_orderkey % 5 AS x2, o_orderkey * 7 % 37 + o_orderkey % 4 AS y2 FROM orders), w AS (SELECT tile_no, MEDIAN(dtm) AS whole FROM pixel GROUP BY tile_no),
    o AS (SELECT way_id, MEDIAN(dtm) AS own FROM r JOIN pixel ON pixel.tile_no = r.tile_no AND pcol >= x1 AND pcol < x2 AND prow >= y1 AND prow < y2 GROUP BY way_id) SELECT r.way_id, COALESCE(own, whole) AS median_dtm FROM r LEFT JOIN o ON o.way_id = r.way_id LEFT JOIN w ON w.tile_no = r.tile_no"""))
def ground_under(v):
    """Median ground under each building's outline, the tile's where no cell centre lies in it."""
    boxes = v.table("orders").selectExpr("o_orderkey AS way_id", "o_custkey % 10 AS tile_no", "o_orderkey % 37 AS x1", "o_orderkey * 7 % 37 AS y1", "o_orderkey % 37 + o_orderkey % 5 AS x2", "o_orderkey * 7 % 37 + o_orderkey % 4 AS y2")
    edge = lambda a, b, c, d: F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2"))
    rings = boxes.select("way_id", "tile_no", F.explode(F.array(edge("x1", "y1", "x2", "y1"), edge("x2", "y1", "x2", "y2"), edge("x2", "y2", "x1", "y2"), edge("x1", "y2", "x1", "y1"))).alias("e")).select("way_id", "tile_no", "e.*")
    return raster.under(v.pixel(), boxes.select("way_id", "tile_no"), rings)


@query(sql("pixel filled", "SELECT tile_no, MIN(z) AS low, MAX(z) AS high, LIST(z ORDER BY z)[CAST(COUNT(*) // 2 AS INT) + 1] AS base FROM (SELECT DISTINCT tile_no, FLOOR(z / 4.0) * 4 AS z FROM filled) GROUP BY tile_no"))
def band_elevations(v):
    banded = raster.bands(raster.fill_holes(v.pixel(), 40, 40), 4.0).select("tile_no", (F.col("band") * 4.0).alias("z"))
    return raster.elevations(banded, "tile_no", "z")


# --- faces and planes -----------------------------------------------------------------------------------------------


@query(f"WITH b AS ({_BOXED}) SELECT spec, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / ((x2 - x1) + (y2 - y1)) AS width FROM b")
def mean_widths(v):
    boxes = v.table("orders").selectExpr("o_orderkey AS spec", "10 + o_orderkey % 83 AS w", "10 + o_orderkey % 71 AS h")
    return boxes.select("spec", faces.mean_width((F.col("w") * F.col("h")).cast("double"), 2.0 * (F.col("w") + F.col("h"))).alias("width"))


@query(sql("way_nodes", "SELECT way_id, COUNT(*) AS corners FROM (SELECT DISTINCT way_id, ROUND_EVEN(x / 4096.0, 0) AS x, ROUND_EVEN(y / 4096.0, 0) AS y FROM way_nodes) GROUP BY way_id HAVING COUNT(*) >= 3"))
def whole_faces(v):
    """Faces that keep three corners once those are rounded."""
    return faces.whole_faces(v.way_nodes().select("way_id", (F.col("x") / 4096.0).alias("x"), (F.col("y") / 4096.0).alias("y")), "way_id")


@query("SELECT o_orderkey, o_custkey % 40 AS tile, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey % 5, CASE WHEN o_orderkey % 7 IN (1, 2) THEN 1 ELSE 0 END, o_orderkey) - 1 AS BIGINT) AS ordinal FROM orders")
def bridges_last(v):
    """Layers of each tile in their order, with bridges at the end of theirs."""
    rows = v.table("orders").selectExpr("o_orderkey", "o_custkey % 40 AS tile", "o_orderkey % 5 AS layer", "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'yes' WHEN 2 THEN 'viaduct' WHEN 3 THEN 'no' ELSE '' END AS bridge")
    return faces.ordered_layers(rows, "tile", "layer", tags.is_bridge(F.col("bridge")).cast("int"), "o_orderkey").select("o_orderkey", "tile", "ordinal")


@query(sql("pts sectors", "SELECT sector, ROUND(CASE WHEN sector % 3 = 0 THEN CAST(height AS DOUBLE) ELSE -((sector % 7) * (x % 1000) + (sector % 5) * (y % 1000) + sector % 11) / CAST(sector % 4 + 1 AS DOUBLE) END, 6) AS z FROM sectors"))
def floor_heights(v):
    """Heights of floors at a point: by their plane, or level."""
    c = F.expr("CASE WHEN sector % 3 <> 0 THEN CAST(sector % 4 + 1 AS DOUBLE) END")
    z = geometry.plane_height(F.expr("sector % 7"), F.expr("sector % 5"), c, F.expr("sector % 11"), F.expr("x % 1000"), F.expr("y % 1000"), F.col("height").cast("double"))
    return v.sectors().select("sector", F.round(z, 6).alias("z"))


@query("SELECT c_custkey, c_custkey / 10.0 AS at0, ROUND((c_custkey % 13) / 800.0 / 32, 12) AS per_x, ROUND(-(c_custkey % 17) / 800.0 / 32, 12) AS per_y FROM customer")
def degree_planes(v):
    """A tile's degrees as a linear form of its units."""
    at = F.col("c_custkey") / 10.0
    plane = placement.degree_plane(at, at + F.col("c_custkey") % 13, at - F.col("c_custkey") % 17, 800)
    return v.table("customer").select("c_custkey", plane["at0"].alias("at0"), *[F.round(plane[k], 12).alias(k) for k in ("per_x", "per_y")])


@query(f"""WITH b AS ({_BOXED}), s AS (SELECT spec, x1, y1, x2 - x1 AS w, (x2 - x1) + (y2 - y1) AS len, GREATEST(2, CAST(FLOOR(((x2 - x1) + (y2 - y1)) / 8.0) AS BIGINT) + 1) AS n FROM b), t AS (SELECT *, UNNEST(RANGE(n)) AS i FROM s)
    SELECT spec, i, ROUND(x1 + LEAST(CAST(w AS DOUBLE), len * i / CAST(n - 1 AS DOUBLE)), 6) AS x, ROUND(y1 + GREATEST(CAST(0 AS DOUBLE), len * i / CAST(n - 1 AS DOUBLE) - w), 6) AS y FROM t""")
def road_samples(v):
    """Points along roads with one corner, one every eight metres or closer."""
    found = placement.samples(_outlines(v, (("x1", "y1"), ("x2", "y1"), ("x2", "y2"))), 8.0, "spec")
    return found.select("spec", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH r AS (SELECT o_orderkey AS way_id, CAST(o_orderkey % 50 AS DOUBLE) AS a, CAST(o_orderkey % 37 AS DOUBLE) AS b, CAST(o_orderkey % 41 AS DOUBLE) AS c, (o_orderkey % 101) / CAST(100 AS DOUBLE) AS t, CAST(o_orderkey % 60 AS DOUBLE) AS ground FROM orders)
    SELECT way_id, GREATEST(a, c) AS deck, ROUND(GREATEST(ground - 10, LEAST(ground + 10, CASE WHEN t * 2 < 1 THEN a + t * 2 * (b - a) ELSE b + (t * 2 - 1) * (c - b) END)), 6) AS z FROM r""")
def road_heights(v):
    """Decks of bridges, and the heights that profiles give within ten metres of the ground."""
    rows = v.table("orders").selectExpr("o_orderkey AS way_id", "array(CAST(o_orderkey % 50 AS DOUBLE), CAST(o_orderkey % 37 AS DOUBLE), CAST(o_orderkey % 41 AS DOUBLE)) AS heights", "(o_orderkey % 101) / 100D AS t", "CAST(o_orderkey % 60 AS DOUBLE) AS ground")
    return rows.select("way_id", placement.deck(F.col("heights")).alias("deck"), F.round(placement.profile_height(F.col("heights"), F.col("t"), F.col("ground"), 10.0), 6).alias("z"))


# --- audits ---------------------------------------------------------------------------------------------------------


@query(sql("edge", """+ m AS (SELECT c_custkey AS sector, c_custkey % 60 AS component, CAST(c_custkey % 17 AS DOUBLE) AS area FROM customer), g AS (SELECT component, SUM(area) AS area, COUNT(*) AS sectors FROM m GROUP BY component HAVING SUM(area) > 20),
    r AS (SELECT x.component, COUNT(*) AS edges, COUNT(*) FILTER (edge.b % 5 <> 0) AS ground_edges FROM edge JOIN m x ON x.sector = edge.a LEFT JOIN m y ON y.sector = edge.b WHERE y.component IS NULL OR y.component <> x.component GROUP BY x.component)
    SELECT g.component, sectors, area, edges, ground_edges FROM g JOIN r ON r.component = g.component WHERE ground_edges > 0.75 * edges"""))
def suspect_pockets(v):
    members = v.table("customer").selectExpr("c_custkey AS sector", "c_custkey % 60 AS component", "CAST(c_custkey % 17 AS DOUBLE) AS area")
    borders = v.edge().selectExpr("a", "b", "CASE WHEN b % 5 <> 0 THEN 'grass' ELSE 'brick' END AS texture")
    return audit.suspect_pockets(members, borders, ["grass", "tarmac"])


@query(sql("way_nodes segs", "SELECT way_id, ROUND(AVG(x), 6) AS cx, ROUND(AVG(y), 6) AS cy FROM (SELECT way_id, x1 AS x, y1 AS y FROM segs UNION ALL SELECT way_id, x2, y2 FROM segs) GROUP BY way_id"))
def sector_centres(v):
    found = audit.centres(sequence.segments(v.way_nodes()), "way_id")
    return found.select("way_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(sql("pts sectors edge", """+ p AS (SELECT DISTINCT LEAST(a, b) AS a, GREATEST(a, b) AS b FROM edge WHERE a <> b), s AS (SELECT sector, flat, sector % 9 AS pa, sector % 7 - 3 AS pb, CASE WHEN sector % 6 <> 0 THEN 20 + sector % 5 END AS pc FROM sectors WHERE sector % 8 >= 2),
    n AS (SELECT * FROM s WHERE pc IS NOT NULL AND (pa <> 0 OR pb <> 0)), d AS (SELECT x.flat, CAST(x.pa * y.pa + x.pb * y.pb + x.pc * y.pc AS DOUBLE) / (SQRT(CAST(x.pa * x.pa + x.pb * x.pb + x.pc * x.pc AS DOUBLE)) * SQRT(CAST(y.pa * y.pa + y.pb * y.pb + y.pc * y.pc AS DOUBLE))) AS q FROM p JOIN n x ON x.sector = p.a JOIN n y ON y.sector = p.b WHERE x.flat = y.flat),
    j AS (SELECT flat, LIST(t ORDER BY t) AS v FROM (SELECT flat, CAST(ROUND_EVEN(DEGREES(ACOS(GREATEST(-1.0, LEAST(1.0, q)))) * 10, 0) AS BIGINT) AS t FROM d) GROUP BY flat)
    SELECT flat, CAST(len(v) AS BIGINT) AS joins, v[LEAST(len(v) - 1, CAST(FLOOR(len(v) * CAST(0.5 AS DOUBLE)) AS BIGINT)) + 1] AS p50, v[LEAST(len(v) - 1, CAST(FLOOR(len(v) * CAST(0.95 AS DOUBLE)) AS BIGINT)) + 1] AS p95, v[len(v)] AS most FROM j"""))
def dihedral_angles(v):
    """Angles between sloped neighbours of one flat, in tenths of a degree."""
    planes = v.sectors().selectExpr("sector", "flat", "CAST(sector % 8 AS DOUBLE) AS area", "sector % 9 AS pa", "sector % 7 - 3 AS pb", "CASE WHEN sector % 6 <> 0 THEN 20 + sector % 5 END AS pc")
    return audit.angles_by_flat(planes, v.edge(), {"p50": 0.5, "p95": 0.95})


# --- spatial --------------------------------------------------------------------------------------------------------

_POINTS = "SELECT s_suppkey AS pt_id, (s_suppkey * 7001) % 12800 AS px, (s_suppkey * 3373) % 12800 AS py FROM supplier"


@query(sql("way_nodes segs", f"""+ p AS ({_POINTS}), d AS (SELECT pt_id, px, py, way_id, seq, x1, y1, x2, y2, COALESCE(GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), ((px - x1) * CAST(x2 - x1 AS DOUBLE) + (py - y1) * CAST(y2 - y1 AS DOUBLE)) / NULLIF(CAST(x2 - x1 AS DOUBLE) * (x2 - x1) + CAST(y2 - y1 AS DOUBLE) * (y2 - y1), 0))), 0) AS t FROM p JOIN segs ON px BETWEEN LEAST(x1, x2) - 300 AND GREATEST(x1, x2) + 300 AND py BETWEEN LEAST(y1, y2) - 300 AND GREATEST(y1, y2) + 300),
    e AS (SELECT *, POW(px - x1 - t * (x2 - x1), 2) + POW(py - y1 - t * (y2 - y1), 2) AS d2 FROM d), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pt_id ORDER BY ROUND(d2, 6), way_id, seq) AS n FROM e WHERE d2 <= 90000)
    SELECT pt_id, way_id, CAST(SIGN((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) AS INT) AS side FROM r WHERE n = 1"""))
def sides_of_lines(v):
    """Which side of the nearest line a point lies on."""
    points = v.table("supplier").selectExpr("s_suppkey AS pt_id", "(s_suppkey * 7001) % 12800 AS px", "(s_suppkey * 3373) % 12800 AS py")
    return scan.side_of_line(points, sequence.segments(v.way_nodes()), 300)


@query("""WITH r AS (SELECT s_suppkey AS district, (s_suppkey * 577) % 12000 AS x1, (s_suppkey * 811) % 12000 AS y1, (s_suppkey * 577) % 12000 + 150 + s_suppkey % 900 AS x2, (s_suppkey * 811) % 12000 + 90 + s_suppkey % 700 AS y2 FROM supplier),
    g AS (SELECT district, y1, y2, UNNEST(RANGE(x1 // 400 - 1, x2 // 400 + 1)) AS cx, x1, x2 FROM r), h AS (SELECT *, UNNEST(RANGE(y1 // 400 - 1, y2 // 400 + 1)) AS cy FROM g) SELECT district, cx, cy FROM h WHERE cx * 400 <= x2 AND cx * 400 + 400 >= x1 AND cy * 400 <= y2 AND cy * 400 + 400 >= y1 AND cx >= (x1 // 400) AND cy >= (y1 // 400)""")
def district_squares(v):
    """Every square of the grid that a district's outline meets."""
    boxes = v.table("supplier").selectExpr("s_suppkey AS way_id", "(s_suppkey * 577) % 12000 AS x1", "(s_suppkey * 811) % 12000 AS y1", "(s_suppkey * 577) % 12000 + 150 + s_suppkey % 900 AS x2", "(s_suppkey * 811) % 12000 + 90 + s_suppkey % 700 AS y2")
    edge = lambda a, b, c, d: F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2"))
    rings = boxes.select("way_id", F.explode(F.array(edge("x1", "y1", "x2", "y1"), edge("x2", "y1", "x2", "y2"), edge("x2", "y2", "x1", "y2"), edge("x1", "y2", "x1", "y1"))).alias("e")).select("way_id", "e.*")
    return scan.squares_of(rings, 400, "district")


@query(sql("edge sides", "+ r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT b FROM r JOIN sides ON a = node WHERE len >= 33 AND step <= 24) SELECT (SELECT COUNT(*) FROM r) AS reached, (SELECT COUNT(*) FROM customer WHERE c_custkey NOT IN (SELECT node FROM r)) AS lost", recursive=True))
def reach_counts(v):
    """Sectors that are reached from the first one, and those that are not."""
    found = graph.reach(v.edge().where("len >= 33 AND step <= 24"), v.spark.range(1, 2).withColumnRenamed("id", "node"))
    lost = v.table("customer").select(F.col("c_custkey").alias("node")).join(found, "node", "left_anti")
    return found.select(F.lit(1).alias("r"), F.lit(0).alias("l")).unionByName(lost.select(F.lit(0).alias("r"), F.lit(1).alias("l"))).agg(F.sum("r").alias("reached"), F.sum("l").alias("lost"))


# --- whole tiles ----------------------------------------------------------------------------------------------------

_FEATURES = "SELECT o_custkey AS tile, o_orderkey AS osm_id, o_orderkey % 4 AS k, (o_orderkey * 37) % 200 AS x1, (o_orderkey * 91) % 200 AS y1, (o_orderkey * 37) % 200 + 2 + o_orderkey % 83 AS x2, (o_orderkey * 91) % 200 + 1 + o_orderkey % 71 AS y2 FROM orders"
#: The same polygons, clipped, with the layer and its least area; roads are six metres wide.
_SPECS = f"""f AS ({_FEATURES}), p AS (SELECT tile, osm_id, k, GREATEST(x1, 0) AS x1, GREATEST(CASE WHEN k = 2 THEN y1 - 3 ELSE y1 END, 0) AS y1, LEAST(x2, 200) AS x2, LEAST(CASE WHEN k = 2 THEN y1 + 3 ELSE y2 END, 200) AS y2 FROM f),
    q AS (SELECT * FROM p WHERE x1 < x2 AND y1 < y2 AND (x2 - x1) * (y2 - y1) >= CASE k WHEN 0 THEN 40 WHEN 3 THEN 8 ELSE 0 END UNION ALL SELECT DISTINCT tile, NULL, -1, 0, 0, 200, 200 FROM f),
    s AS (SELECT *, CASE k WHEN -1 THEN 'base' WHEN 0 THEN 'landuse' WHEN 1 THEN 'water' WHEN 2 THEN 'roads' ELSE 'buildings' END AS layer, ROW_NUMBER() OVER (PARTITION BY tile ORDER BY k, osm_id) - 1 AS spec FROM q)"""


def _features(v):
    rows = v.table("orders").selectExpr(
        "o_custkey AS tile", "o_orderkey AS osm_id", "element_at(array('landuse', 'water', 'roads', 'buildings'), CAST(o_orderkey % 4 AS INT) + 1) AS bucket", "CAST(NULL AS STRING) AS bridge", "CASE WHEN o_orderkey % 4 = 2 THEN 6D END AS width_m",
        "CAST((o_orderkey * 37) % 200 AS DOUBLE) AS x1", "CAST((o_orderkey * 91) % 200 AS DOUBLE) AS y1", "CAST((o_orderkey * 37) % 200 + 2 + o_orderkey % 83 AS DOUBLE) AS x2", "CAST((o_orderkey * 91) % 200 + 1 + o_orderkey % 71 AS DOUBLE) AS y2",
    )
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring, line = F.array(*[corner(x, y) for x, y in _BOX]), F.array(corner("x1", "y1"), corner("x2", "y1"))
    return rows.withColumn("points", F.when(F.col("bucket") == "roads", line).otherwise(ring)).drop("x1", "y1", "x2", "y2")


#: Floor, ceiling and wall of each layer.
_STYLE = {"base": (0, 9, "earth"), "landuse": (0, 9, "grass"), "water": (-1, 9, "stone"), "roads": (0, 9, "kerb"), "railways": (0, 9, "gravel"), "barriers": (2, 9, "hedge"), "buildings": (6, 9, "brick")}


@query(f"WITH {_SPECS} SELECT tile, layer, COUNT(*) AS specs, CAST(SUM((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area, MAX(spec) AS last FROM s GROUP BY tile, layer")
def tile_layers(v):
    """The polygons of each layer of a tile, clipped and in order."""
    known = build.specs(_features(v), (0, 0, 200, 200))
    return known.groupBy("tile", "layer").agg(F.count("*").alias("specs"), F.sum(polygons.parts_area(F.array("points"))).alias("area"), F.max("spec").alias("last"))


@query(f"""WITH {_SPECS}, xs AS (SELECT tile, x, LEAD(x) OVER (PARTITION BY tile ORDER BY x) AS x2 FROM (SELECT tile, x1 AS x FROM s UNION SELECT tile, x2 FROM s)), ys AS (SELECT tile, y, LEAD(y) OVER (PARTITION BY tile ORDER BY y) AS y2 FROM (SELECT tile, y1 AS y FROM s UNION SELECT tile, y2 FROM s)),
    c AS (SELECT xs.tile, (xs.x2 - xs.x) * (ys.y2 - ys.y) AS a, MAX(s.spec) AS spec FROM xs JOIN ys ON ys.tile = xs.tile JOIN s ON s.tile = xs.tile AND s.x1 <= xs.x AND s.x2 >= xs.x2 AND s.y1 <= ys.y AND s.y2 >= ys.y2 GROUP BY xs.tile, xs.x, ys.y, xs.x2, ys.y2),
    g AS (SELECT c.tile, layer AS cover, CAST(SUM(a) AS DOUBLE) AS area FROM c JOIN s ON s.tile = c.tile AND s.spec = c.spec GROUP BY c.tile, layer) SELECT tile, cover, area, ROUND_EVEN(area * 100.0 / SUM(area) OVER (PARTITION BY tile), 1) AS pct FROM g""")
def tile_cover(v):
    """What each built tile shows, by the area of its sectors."""
    return build.build(_features(v), (0, 0, 200, 200), _STYLE).cover


@query("SELECT o_custkey AS tile, CAST(0 AS BIGINT) AS open_corners, CAST(4 AS BIGINT) AS border_sides, CAST(0 AS BIGINT) AS inner_walls FROM orders GROUP BY 1")
def tile_parity(v):
    """Built tiles are closed: an even number of edges meets at each corner of a sector, and only the border has one-sided lines."""
    return build.build(_features(v), (0, 0, 200, 200), _STYLE).closed.drop("faces")
