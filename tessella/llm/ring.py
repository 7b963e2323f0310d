"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every row hashes to a place on the ring by its text, so equal texts start together; its arc ends at a virtual node of a
shard. A shard takes rows until its capacity is reached; the rest of the arc goes on clockwise to the next node with room.
Only the row counts of the arcs (their number is a parameter) reach the driver, which plans whole intervals of ranks;
the rows are then ranked within small sub-arcs, so an arc with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.store import written

SHARDS, REPLICAS = 40, 64
#: Rows of a sub-arc, at least, and sub-arcs at most: what one sort of ranks holds.
SUB_ROWS, SUB_ARCS = 256, 100_000


def ring(shards: int, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in order, and the shard of each."""
    if shards < 1 or replicas < 1:
        raise ValueError("a ring needs at least one shard and one replica")
    place = np.array([xxhash.xxh64_intdigest(f"shard-{s}-node-{r}", 0) - 2**63 for s in range(shards) for r in range(replicas)], np.int64)
    owner = np.repeat(np.arange(shards), replicas)
    order = np.lexsort((owner, place))
    return place[order], owner[order]


def plan(counts: dict[int, int], owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, first rank, end rank, shard, first slot) that place every row.

    Walks clockwise: a node takes what was carried to it and then its own arc, as far as its shard has room.
    """
    room, used, carried, out = capacity.copy(), np.zeros(len(capacity), np.int64), [], []
    left = sum(counts.values())
    if left > room.sum():
        raise ValueError("the shards are too small for the rows")
    for step in range(2 * len(owner) + 1):
        if step >= len(owner) and not carried:
            break
        node = step % len(owner)
        if step < len(owner) and counts.get(node, 0):
            carried.append((node, 0, counts[node]))
        shard, rest = owner[node], []
        for arc, lo, hi in carried:
            take = min(int(room[shard]), hi - lo)
            if take:
                out.append((arc, lo, lo + take, int(shard), int(used[shard])))
                room[shard] -= take
                used[shard] += take
            if lo + take < hi:
                rest.append((arc, lo + take, hi))
        carried = rest
    return out


def shard(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, load: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row.

    load None: capacities add up to the number of rows and are at most one apart, so row counts are too. Otherwise a
    shard takes at most ceil(load * rows / shards) rows (load >= 1), which moves fewer rows when a shard is added.
    Null text: size 16, crc 0, placed like an empty text. Equal texts share a shard as far as it has room; repeated rows
    get slots of their own; null ids are placed by their text, in an order of their own in each run; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("place"),
        # Rows without an id are turned by their number, so that many of them with one text do not meet in one sub-arc.
        F.coalesce(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"))), F.xxhash64(F.monotonically_increasing_id(), F.lit(1))).alias("turn"),
    )
    places, owner = ring(shards, replicas)

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(places, place.to_numpy(), "left") % len(places)).astype(np.int32))

    rows = written(rows.withColumn("arc", arc("place")).drop("place"), "ring")
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # bounded by shards * replicas
    total = sum(counts.values())
    if load is None:
        capacity = np.full(shards, total // shards, np.int64)
        capacity[: total % shards] += 1
    else:
        capacity = np.full(shards, int(np.ceil(max(1.0, load) * total / shards)), np.int64)
    intervals = spark.createDataFrame(plan(counts, owner, capacity), "arc int, lo long, hi long, shard int, base long")
    sub_rows = max(SUB_ROWS, total // SUB_ARCS)
    subs = spark.createDataFrame([(a, -(-c // sub_rows)) for a, c in counts.items()], "arc int, subs int")
    # Sub-arcs follow the order of turn, so ranks within an arc are those of one sort by (turn, doc_id).
    sub = F.least(F.floor((F.col("turn") / F.lit(2.0**64) + 0.5) * F.col("subs")), F.col("subs") - 1).cast("int")
    rows = rows.join(F.broadcast(subs), "arc").withColumn("sub", sub)  # at most shards * replicas rows
    sizes = rows.groupBy("arc", "sub").count()
    before = sizes.select("arc", "sub", (F.sum("count").over(W.partitionBy("arc").orderBy("sub")) - F.col("count")).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy("arc", "sub").orderBy("turn", "doc_id", "text_crc32", "size")) - 1)
    ranked = ranked.join(before, ["arc", "sub"]).withColumn("rank", F.col("nth") + F.col("before")).drop("subs")
    # Intervals: one an arc, and one more each time a shard fills up or the walk passes a node with carried rows.
    placed = ranked.alias("r").join(F.broadcast(intervals).alias("i"), (F.col("r.arc") == F.col("i.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
