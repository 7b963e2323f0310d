"""Telemetry of players: lines, stuck episodes, edges of tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the detector: ticks until a report, distinct eighths of a turn, and ticks of rest after it.
STUCK_TICKS, STUCK_OCTANTS, REST_TICKS = 35, 3, 105


def parse_line(line: Column) -> dict[str, Column]:
    """Fields of a breadcrumb line; null where the line is another."""
    field = lambda name, kind: F.nullif(F.regexp_extract(line, rf"^P2W TLM .*\b{name}=(-?[\w.]+)", 1), F.lit("")).try_cast(kind).alias(name)
    return {"map": field("map", "string"), **{k: field(k, "double") for k in ("x", "y", "z", "lat", "lng", "ang", "spd")}, **{k: field(k, "int") for k in ("fwd", "side")}}


class Detector:
    """The stuck state of one player."""

    def __init__(self, ticks: int = 0, mask: int = 0, limits: tuple[int, int, int] = (STUCK_TICKS, STUCK_OCTANTS, REST_TICKS)):
        self.ticks, self.mask, self.limits = ticks, mask, limits

    def step(self, pushing: bool, slow: bool, angle: float) -> int:
        """Takes one tick; the number of distinct octants if it makes a report, else 0."""
        if pushing and slow:
            self.ticks += 1
            self.mask |= 1 << (int((angle % 360) / 45) & 7)
        elif self.ticks < 0:
            self.ticks += 1
        else:
            self.ticks = self.mask = 0
        if self.ticks >= self.limits[0] and self.mask.bit_count() >= self.limits[1]:
            octants, self.ticks, self.mask = self.mask.bit_count(), -self.limits[2], 0
            return octants
        return 0


def stuck(ticks: DataFrame, key: str = "user_id", order: str = "event_id", limits: tuple[int, int, int] = (STUCK_TICKS, STUCK_OCTANTS, REST_TICKS)) -> DataFrame:
    """Reports (key, order, octants) of the detector over each player's ticks in order.

    Rows are sorted by player within partitions and read in batches: no player's ticks are held together.
    """
    schema = f"{key} long, {order} long, octants int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, state = None, Detector(limits=limits)
        for batch in batches:
            out = []
            for who, at, pushing, slow, angle in batch.itertuples(index=False):
                if who != player:
                    player, state = who, Detector(limits=limits)
                if octants := state.step(pushing, slow, angle):
                    out.append((who, at, octants))
            yield pd.DataFrame(out, columns=[key, order, "octants"])

    rows = ticks.select(key, order, "pushing", "slow", "ang")
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def transitions(ticks: DataFrame, size: int, margin: int) -> DataFrame:
    """Ticks within margin of a tile's edge: direction of the neighbour and where the player arrives in it (mirrored)."""
    x, y = F.col("x"), F.col("y")
    direction = F.when(x < margin, "W").when(x >= size - margin, "E").when(y < margin, "S").when(y >= size - margin, "N")
    to_x = F.when(direction == "W", size - 2 * margin).when(direction == "E", 2 * margin).otherwise(x)
    to_y = F.when(direction == "S", size - 2 * margin).when(direction == "N", 2 * margin).otherwise(y)
    return ticks.withColumns({"direction": direction, "to_x": to_x, "to_y": to_y}).where(F.col("direction").isNotNull())


def throttled(ticks: DataFrame, every: int = 10, least_speed: float = 0.5) -> DataFrame:
    """The ticks that are written: every tenth, if the player pushes or moves. ticks: tick, pushing, speed."""
    return ticks.where((F.col("tick") % every == 0) & (F.col("pushing") | (F.col("speed") >= least_speed)))
