import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import grid
from tessella.operators import rollup, vegetation
from tessella.sources import archives, elements


def test_lumps():
    data = archives.pack_lumps([("F_START", b""), ("grass", b"abc"), ("F_END", b""), ("TEXTURE1", b"")])
    assert archives.lump_directory(data) == [("F_START", 0, 0), ("GRASS", 12, 3), ("F_END", 0, 0), ("TEXTURE1", 0, 0)]
    with pytest.raises(ValueError):
        archives.lump_directory(b"ZWAD" + bytes(8))
    with pytest.raises(ValueError):
        archives.pack_lumps([("NINE_LONG", b"")])
    assert archives.texture_names((1).to_bytes(4, "little") + (8).to_bytes(4, "little") + b"BRICK\0\0\0") == ["BRICK"]
    assert archives.texture_names(b"") == []


def test_lumps_between_markers(spark):
    data = archives.pack_lumps([("A", b"1"), ("F_START", b""), ("B", b"22"), ("C", b""), ("F_END", b""), ("D", b"4")])
    lumps = archives.read_lumps(spark.createDataFrame([("x", bytearray(data)), ("none", None)], "path string, content binary"))
    assert [(r["name"], bytes(r["data"])) for r in archives.between(lumps, "path", ["F_START"], ["F_END"]).collect()] == [("B", b"22")]


def test_packs(spark, tmp_path):
    layer = lambda rows: spark.createDataFrame(rows, "pack string, member string, data binary")
    members = archives.last_members(layer([("p", "a", bytearray(b"old")), ("p", "b", bytearray(b"b")), ("q", "a", None)]), layer([("p", "a", bytearray(b"new"))]))
    written = archives.write_packs(members, str(tmp_path)).collect()
    assert sorted((r["pack"], r["members"]) for r in written) == [("p", 2), ("q", 1)]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["p.pk3", "q.pk3"]
    assert zipfile.ZipFile(tmp_path / "p.pk3").read("a") == b"new"
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.pk3")
    assert sorted((r["member"], r["size"]) for r in archives.read_packs(files).collect()) == [("a", 0), ("a", 3), ("b", 1)]


def test_index(spark, tmp_path):
    nodes = [(1, 0, 5, 5), (1, 1, 25, 5), (2, 0, 95, 95), (2, 1, 96, 96), (3, 0, 1, 1), (4, 0, 1, 1), (4, 1, None, 3)]
    assert elements.write_index(spark.createDataFrame(nodes, "way_id long, seq long, x long, y long"), f"{tmp_path}/i", 10) == 2
    index = spark.read.parquet(f"{tmp_path}/i")
    ids = lambda box: sorted(r["way_id"] for r in elements.scan_index(index, box, 10).collect())
    assert (ids((0, 0, 100, 100)), ids((12, 0, 14, 9)), ids((26, 0, 90, 90)), ids((25, 5, 30, 30))) == ([1, 2], [1], [], [1])


def test_elements(spark):
    text = '{"elements": [{"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 1, "lon": 2}]}, {"type": "relation", "id": 2}, {"type": "way", "id": 3, "geometry": [{"lat": 1, "lon": 2}]}]}'
    got = elements.read_elements(spark.createDataFrame([(text,), ("<busy>",), (None,)], "value string"))
    assert [(r["osm_id"], r["closed"]) for r in got.collect()] == [(1, True)]
    kept = lambda *s: got.where(elements.matches(F.col("tags"), list(s))).count()
    assert (kept('way["building"]'), kept('way["building"="no"]'), kept('node["building"]'), kept('way["x"]', 'nwr["building"="yes"]')) == (1, 0, 0, 1)
    with pytest.raises(ValueError):
        elements.selector("way[building]")


@pytest.mark.parametrize("parish, ward, district, name", [("Ash", "W", "Dover", "Ash, Dover"), ("Dover, unparished area", "Castle", "Dover", "Castle, Dover"), (None, "Dover", "Dover", "Dover"), (None, None, "Dover", "Dover"), ("Ash", None, None, "Ash")])
def test_place_names(spark, parish, ward, district, name):
    c = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(elements.place_name(c(parish), c(ward), c(district)).alias("n")).first()["n"] == name


def test_meta(spark):
    rows = rollup.read_meta(spark.createDataFrame([('{"tile": "a", "n": 3}',), ('{"tile": ',), (None,)], "value string"), "tile string, n long").collect()
    assert [r["done"] for r in rows] == [True, False, False]


def test_log(spark, tmp_path):
    for k in (1, 2):
        rollup.append_log(spark.createDataFrame([(k, "built")], "tile long, outcome string"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2


def test_names_and_colours(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert (one(grid.lump_name("DMM", F.lit(6))), one(grid.lump_name("DMM", F.lit(104)))) == ("DMM07", "DMM105")
    with pytest.raises(Exception, match="eight characters"):
        one(grid.lump_name("DMM", F.lit(999999)))
    assert (one(grid.degrees_text(F.lit(51.5), "N", "S")), one(grid.degrees_text(F.lit(-0.25), "E", "W"))) == ("51.50000N", "0.25000W")
    assert tuple(one(grid.shade(F.lit(9.0), F.lit(0.0), F.lit(3.0)))) == (196, 204, 156)
    assert tuple(one(grid.shade(F.lit(9.0), F.lit(9.0), F.lit(0.0)))) == (46, 74, 46)


def test_scattered_trees(spark):
    rows = [(1, 4500.0, 0.0, 0.0, 100.0, 45.0, 50.0, 20.0), (2, 10.0, 0.0, 0.0, 5.0, 2.0, 2.5, 1.0), (3, 900.0, 0.0, 0.0, 30.0, 30.0, 7.0, 7.0)]
    patches = spark.createDataFrame(rows, "patch long, area double, west double, south double, east double, north double, cx double, cy double")
    trees = vegetation.scatter(patches, lambda df: df.where("patch <> 3"))  # nothing of patch 3 falls inside
    got = {}
    for r in trees.collect():
        got.setdefault(r["patch"], []).append((r["x"], r["y"]))
    assert 80 <= len(got[1]) <= 120 and got[2] == [(2.5, 1)] and got[3] == [(7, 7)]
    assert sorted(map(tuple, trees.collect())) == sorted(map(tuple, trees.collect()))
