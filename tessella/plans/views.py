"""Relations of the engine, projected from the driver's tables; SQL gives the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Views:
    """The relations over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def pts(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS pt_id", "540000 + (c_custkey * 7919) % 100000 AS easting", "116000 + (c_custkey * 104729) % 64000 AS northing", "CAST(c_nationkey AS BIGINT) AS district_id")

    def pt_tile(self) -> DataFrame:
        return self.pts().selectExpr("pt_id", "district_id", "easting", "northing", "CAST(FLOOR(easting / 800D) AS BIGINT) AS ix", "CAST(FLOOR(northing / 800D) AS BIGINT) AS iy")

    def district_tile(self) -> DataFrame:
        return self.pt_tile().select("district_id", "ix", "iy").distinct()

    def ways(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS osm_id", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'house' END AS building", "CASE WHEN o_orderkey % 3 = 0 THEN 'residential' WHEN o_orderkey % 11 = 0 THEN 'footway' END AS highway",
            "CASE WHEN o_orderkey % 13 = 0 THEN 'rail' END AS railway", "CASE WHEN o_orderpriority = '2-HIGH' THEN 'hedge' END AS barrier", "CASE WHEN o_orderkey % 17 = 0 THEN 'riverbank' END AS waterway",
            "CASE WHEN o_orderkey % 5 = 0 THEN 'coastline' WHEN o_orderkey % 7 = 0 THEN 'water' WHEN o_orderkey % 7 = 1 THEN 'wood' END AS natural_", "CASE WHEN o_orderpriority = '5-LOW' THEN 'farmland' END AS landuse", "o_orderstatus = 'F' AS closed",
            "CASE o_orderkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '12 m' WHEN 2 THEN concat('40', chr(39)) WHEN 3 THEN '30ft' WHEN 4 THEN '7,5m' ELSE '12d' END AS height_tag",
        )

    def way_nodes(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        rows = self.table("lineitem").withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
        return rows.selectExpr("l_orderkey AS way_id", "seq", "(l_partkey * 37) % 12800 AS x", "(l_suppkey * 9973 + l_linenumber * 131) % 12800 AS y")

    def pixel(self) -> DataFrame:
        cells = self.table("lineitem").selectExpr("l_suppkey % 10 AS tile_no", "l_partkey % 40 AS prow", "l_orderkey % 40 AS pcol", "l_quantity")
        return cells.groupBy("tile_no", "prow", "pcol").agg(F.min("l_quantity").alias("dtm"), F.max("l_quantity").alias("dsm"))

    def telemetry(self) -> DataFrame:
        return self.table("events").selectExpr("user_id", "event_id", "ts", "CAST(FLOOR(value * 32) AS BIGINT) % 25600 AS x", "(event_id * 7919) % 25600 AS y", "event_type IN ('click', 'view', 'error') AS pushing", "value < 20 AS slow", "(event_id * 37) % 360 AS ang")

    def edge(self) -> DataFrame:
        n = self.table("customer").agg(F.count("*").alias("n"))
        return self.table("orders").crossJoin(F.broadcast(n)).selectExpr("o_custkey AS a", "(o_custkey * 31 + o_orderkey * 17) % n AS b", "o_orderkey % 100 AS len", "o_orderkey % 48 AS step")  # one row

    def sectors(self) -> DataFrame:
        return self.pts().selectExpr("pt_id AS sector", "easting * 32 AS x", "northing * 32 AS y", "(pt_id * 7919) % 400 AS height", "district_id % 5 AS flat")

    def pack_member(self) -> DataFrame:
        return self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_suppkey AS pack", "p_brand AS member", "p_type AS sig").distinct()


#: The same relations as common table expressions.
SQL = {
    "pts": "SELECT c_custkey AS pt_id, 540000 + (c_custkey * 7919) % 100000 AS easting, 116000 + (c_custkey * 104729) % 64000 AS northing, CAST(c_nationkey AS BIGINT) AS district_id FROM customer",
    "pt_tile": "SELECT pt_id, district_id, easting, northing, CAST(FLOOR(easting / CAST(800 AS DOUBLE)) AS BIGINT) AS ix, CAST(FLOOR(northing / CAST(800 AS DOUBLE)) AS BIGINT) AS iy FROM pts",
    "district_tile": "SELECT DISTINCT district_id, ix, iy FROM pt_tile",
    "ways": """SELECT o_orderkey AS osm_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'house' END AS building, CASE WHEN o_orderkey % 3 = 0 THEN 'residential' WHEN o_orderkey % 11 = 0 THEN 'footway' END AS highway,
        CASE WHEN o_orderkey % 13 = 0 THEN 'rail' END AS railway, CASE WHEN o_orderpriority = '2-HIGH' THEN 'hedge' END AS barrier, CASE WHEN o_orderkey % 17 = 0 THEN 'riverbank' END AS waterway,
        CASE WHEN o_orderkey % 5 = 0 THEN 'coastline' WHEN o_orderkey % 7 = 0 THEN 'water' WHEN o_orderkey % 7 = 1 THEN 'wood' END AS natural_, CASE WHEN o_orderpriority = '5-LOW' THEN 'farmland' END AS landuse, o_orderstatus = 'F' AS closed,
        CASE o_orderkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '12 m' WHEN 2 THEN '40''' WHEN 3 THEN '30ft' WHEN 4 THEN '7,5m' ELSE '12d' END AS height_tag FROM orders""",
    "way_nodes": "SELECT l_orderkey AS way_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS seq, (l_partkey * 37) % 12800 AS x, (l_suppkey * 9973 + l_linenumber * 131) % 12800 AS y FROM lineitem",
    "pixel": "SELECT l_suppkey % 10 AS tile_no, l_partkey % 40 AS prow, l_orderkey % 40 AS pcol, MIN(l_quantity) AS dtm, MAX(l_quantity) AS dsm FROM lineitem GROUP BY 1, 2, 3",
    "telemetry": "SELECT user_id, event_id, ts, CAST(FLOOR(value * 32) AS BIGINT) % 25600 AS x, (event_id * 7919) % 25600 AS y, event_type IN ('click', 'view', 'error') AS pushing, value < 20 AS slow, (event_id * 37) % 360 AS ang FROM events",
    "edge": "SELECT o_custkey AS a, (o_custkey * 31 + o_orderkey * 17) % (SELECT COUNT(*) FROM customer) AS b, o_orderkey % 100 AS len, o_orderkey % 48 AS step FROM orders",
    "sectors": "SELECT pt_id AS sector, easting * 32 AS x, northing * 32 AS y, (pt_id * 7919) % 400 AS height, district_id % 5 AS flat FROM pts",
    "pack_member": "SELECT DISTINCT l_suppkey AS pack, p_brand AS member, p_type AS sig FROM lineitem JOIN part ON l_partkey = p_partkey",
    "segs": "SELECT * FROM (SELECT way_id, seq, x AS x1, y AS y1, LEAD(x) OVER w AS x2, LEAD(y) OVER w AS y2 FROM way_nodes WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE x2 IS NOT NULL",
    "ring": "SELECT way_id, seq, x1, y1, x2, y2 FROM (SELECT way_id, seq, x AS x1, y AS y1, COALESCE(LEAD(x) OVER w, FIRST_VALUE(x) OVER w) AS x2, COALESCE(LEAD(y) OVER w, FIRST_VALUE(y) OVER w) AS y2, COUNT(*) OVER (PARTITION BY way_id) AS n FROM way_nodes WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE n >= 4",
    "box": "SELECT way_id, MIN(x) AS west, MIN(y) AS south, MAX(x) AS east, MAX(y) AS north, COUNT(*) AS points FROM way_nodes GROUP BY way_id",
    "query_box": "SELECT s_suppkey AS query_id, (s_suppkey * 577) % 12000 AS q_west, (s_suppkey * 811) % 12000 AS q_south, (s_suppkey * 577) % 12000 + 300 AS q_east, (s_suppkey * 811) % 12000 + 300 AS q_north FROM supplier",
    "sides": "SELECT a, b, len, step FROM edge WHERE a <> b UNION ALL SELECT b, a, len, step FROM edge WHERE a <> b",
    "filled": "SELECT t.tile_no, r.prow, c.pcol, COALESCE(p.dtm, m.z) AS z FROM (SELECT tile_no, MEDIAN(dtm) AS z FROM pixel GROUP BY tile_no) m JOIN (SELECT DISTINCT tile_no FROM pixel) t ON t.tile_no = m.tile_no CROSS JOIN (SELECT UNNEST(RANGE(40)) AS prow) r CROSS JOIN (SELECT UNNEST(RANGE(40)) AS pcol) c LEFT JOIN pixel p ON p.tile_no = t.tile_no AND p.prow = r.prow AND p.pcol = c.pcol",
}


def sql(names: str, query: str, recursive: bool = False) -> str:
    """query after the named relations."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + (", " if query.lstrip().startswith("+") else " ") + query.lstrip().removeprefix("+")
