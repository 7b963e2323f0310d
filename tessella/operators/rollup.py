"""Roll-ups over districts, tiles and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def world_total(district_tiles: DataFrame, size: int) -> DataFrame:
    """Ground that exists, each square counted once, beside the sum that counts shared squares again."""
    once = district_tiles.groupBy("ix", "iy").agg(F.count("*").alias("districts"))
    area = lambda n: F.round(n * F.lit(size * size / 1e6), 2)
    totals = once.agg(F.count("*").alias("tiles"), F.coalesce(F.sum("districts"), F.lit(0)).alias("tiles_with_overlap"), F.count_if(F.col("districts") > 1).alias("shared_tiles"))
    return totals.select("tiles", "tiles_with_overlap", "shared_tiles", area(F.col("tiles")).alias("area_km2"))


def common_members(members: DataFrame) -> DataFrame:
    """Members (member, sig) that every pack holds. members: pack, member, sig."""
    packs = members.select("pack").distinct().agg(F.count("*").alias("packs"))
    held = members.distinct().groupBy("member", "sig").agg(F.count("*").alias("n"))
    return held.join(F.broadcast(packs), F.col("n") == F.col("packs")).select("member", "sig", "n")  # one row


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def unfinished(plan: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return plan.join(done.select(*on).distinct(), on, "left_anti")


def pack_plan(plan: DataFrame, artifacts: DataFrame, by: str) -> DataFrame:
    """Plan rows (by, place, tile) with outcome and, for built ones, their number in the pack without gaps; tiles without an artifact are missing."""
    joined = plan.join(artifacts.select(by, "tile", "outcome"), [by, "tile"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    built = F.col("outcome") == "built"
    number = F.sum(built.cast("long")).over(W.partitionBy(by).orderBy("place"))
    return joined.withColumn("number", F.when(built, number - 1))


def region_summary(tiles: DataFrame, by: str) -> DataFrame:
    """Built tiles, sectors and lines of a region, its skipped tiles, and its largest tile by bytes (first id on ties)."""
    built = F.col("outcome") == "built"
    return tiles.groupBy(by).agg(
        F.count_if(built).alias("tiles"), F.coalesce(F.sum(F.when(built, F.col("sectors"))), F.lit(0)).alias("sectors"), F.coalesce(F.sum(F.when(built, F.col("lines"))), F.lit(0)).alias("lines"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.max_by("tile", F.struct("bytes", -F.col("tile"))).alias("largest"),
    )


def append_log(rows: DataFrame, folder: str) -> None:
    """Progress rows as JSON, one a line; earlier ones stay."""
    rows.write.mode("append").json(folder)


def read_meta(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """texts with done and meta: text that is missing or broken is not done."""
    meta = F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = texts.withColumn("meta", meta)
    return parsed.withColumn("done", F.col("meta").isNotNull() & F.col("meta._broken").isNull())


def uncovered(wanted: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """What is wanted and not held; a scan is allowed if this is empty."""
    return wanted.join(held.select(*on).distinct(), on, "left_anti")


# Outcomes of a fetch that are failures, by how they begin.
FAILURES = ["MISSING", "METADATA-ONLY", "BAD ZIP", "FAILED"]


def outcome(status: Column, members: Column, tries: Column, most: int = 4) -> Column:
    """What became of one fetched square: no file, no raster in it, broken, given up, or here."""
    return F.when(status == 404, "MISSING").when(tries >= most, F.format_string("FAILED after %d", tries)).when(members.isNull(), "BAD ZIP").when(members == 0, "METADATA-ONLY").otherwise("OK")


def failures(log: DataFrame, by: str, text: str = "outcome") -> DataFrame:
    """Rows and failures of each group; exhausted retries are failures, too."""
    failed = F.lit(False)
    for start in FAILURES:
        failed = failed | F.col(text).startswith(start)
    return log.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(failed).alias("failed"))


def tallies(log: DataFrame, by: str) -> DataFrame:
    """Reads from local files and from the network, and the distinct sources. log: by, local, source."""
    return log.groupBy(by).agg(F.count_if("local").alias("local"), F.count_if(~F.col("local")).alias("network"), F.countDistinct("source").alias("sources"))


def layer_counts(specs: DataFrame, by: str, layers: list[str]) -> DataFrame:
    """How many specs of each layer a tile has; zero where none. specs: by, layer."""
    return specs.groupBy(by).agg(*[F.count_if(F.col("layer") == name).alias(name) for name in layers])


def cover_percent(areas: DataFrame, by: str, cover: str) -> DataFrame:
    """Share of each cover in the area of its tile's arrangement, in percent to one decimal, halves to even. areas: by, cover, area."""
    sums = areas.groupBy(by, cover).agg(F.sum("area").alias("area"))
    return sums.withColumn("pct", F.bround(F.col("area") * 100.0 / F.sum("area").over(W.partitionBy(by)), 1)).where("area > 0")


def eta(log: DataFrame, by: str, order: str, seconds: str, total: str) -> DataFrame:
    """Tiles done, and the seconds left at the mean pace so far, after each row of a run."""
    w = W.partitionBy(by).orderBy(order)
    done, spent = F.row_number().over(w), F.sum(seconds).over(w)
    return log.withColumns({"done": done.cast("long"), "eta": spent * (F.col(total) - done) / done})


def widest_file(files: DataFrame, by: str) -> DataFrame:
    """The largest extract of each folder, the first path on ties. files: by, path, size."""
    best = files.groupBy(by).agg(F.max("size").alias("size"))
    return files.join(best, [by, "size"]).groupBy(by).agg(F.min("path").alias("path"), F.max("size").alias("size"))


def pack_rest(members: DataFrame) -> DataFrame:
    """Members of each pack that are not held by all packs alike. members: pack, member, sig."""
    return members.select("pack", "member", "sig").distinct().join(common_members(members), ["member", "sig"], "left_anti")
