import pytest
from pyspark.sql import functions as F

from tessella.functions import grid, tags
from tessella.operators import graph, raster, telemetry
from tessella.sources import textmap


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("text, metres", [("12", 12), ("12 m", 12), ("12.5m", 12.5), ("7,5m", 7.5), ("40'", 12.192), ("30ft", 9.144), ("12d", None), ("", None), (None, None), ("tall", None), (" 3 ft", 0.9144), ("1e1", 10)])
def test_lengths(spark, text, metres):
    got = one(spark, tags.parse_length(F.lit(text).cast("string")))
    assert got == (None if metres is None else pytest.approx(metres))


def test_classes(spark):
    rows = [("house", None, None, None, None, None, None, None, True, 3), ("house", "residential", None, None, None, None, None, None, True, 5), (None, None, None, "hedge", "riverbank", None, None, None, True, 5), (None, None, None, None, None, "wood", None, None, False, 5), (None, None, None, None, None, "coastline", None, None, False, 2), (None, None, None, None, None, None, None, "park", True, 9)]
    names = "building highway railway barrier waterway natural landuse leisure closed points".split()
    kinds = ", ".join(f"{n} {'boolean' if n == 'closed' else 'int' if n == 'points' else 'string'}" for n in names)
    got = spark.createDataFrame(rows, kinds).select(tags.bucket(*[F.col(n) for n in names]).alias("b")).collect()
    assert [r["b"] for r in got] == [None, "buildings", "water", None, "coastline", "landuse"]


def test_heights(spark):
    c = lambda x: F.lit(x).cast("string")
    cases = [(("9 m", "4", "church", None), 9), (("0", "2", None, None), 7.2), ((None, "x", "garage", None), 2.6), ((None, None, None, "place_of_worship"), 14), ((None, None, "yes", None), 7)]
    for args, metres in cases:
        assert one(spark, tags.building_height(*map(c, args))) == pytest.approx(metres)


def test_grid(spark):
    assert one(spark, grid.grid_tile(F.lit(625000), F.lit(165000))) == "TR2565"
    assert one(spark, grid.grid_square(F.lit(429157), F.lit(623009))) == "NU"
    assert one(spark, grid.cells(F.lit(625000), F.lit(630000), 5000)) == [625000]
    assert one(spark, grid.cells(F.lit(629600), F.lit(630400), 5000)) == [625000, 630000]
    assert one(spark, grid.tile_index(F.lit(-1))) == -1
    assert one(spark, grid.slug(F.lit("  Royal Tunbridge -- Wells! "))) == "royal-tunbridge-wells"


def test_holes(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0)], "tile_no long, prow long, pcol long, dtm double")
    assert {(r["prow"], r["pcol"]): r["z"] for r in raster.fill_holes(cells, 2, 2).collect()}[1, 1] == 2.0


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 6), (9, 8)], "a long, b long")
    assert {r["node"] for r in graph.reach(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {1, 2, 3}
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    assert dict(map(tuple, graph.components(nodes, edges).collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10}


def test_breadcrumbs(spark):
    line = "P2W TLM map=MAP01 x=-12 y=34 z=-8 lat=51.123456 lng=1.2 ang=90 fwd=1 side=-1 spd=6.5"
    frame = spark.createDataFrame([(line,), ("P2W STUCK map=MAP01 x=1",)], "value string")
    a, b = frame.select(*telemetry.parse_line(F.col("value")).values()).collect()
    assert (a["map"], a["x"], a["z"], a["side"], a["spd"]) == ("MAP01", -12, -8, -1, 6.5) and b["map"] is None


def test_text_blocks(spark):
    text = 'vertex { x = 1.5; y = -2; }\nsector { heightfloor = 8; texturefloor = "GRASS"; }\nvertex { x = 3; y = 4; }'
    frame = spark.createDataFrame([("m", text)], "map string, text string")
    got = textmap.read_blocks(frame, "vertex").orderBy("id").collect()
    assert [(r["id"], r["fields"]["x"], r["fields"]["y"]) for r in got] == [(0, "1.5", "-2"), (1, "3", "4")]
