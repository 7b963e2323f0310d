"""The stuck detector and the parser over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.telemetry import REST_TICKS, STUCK_OCTANTS, STUCK_TICKS, Detector, parse_line


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Breadcrumb rows from a folder that log files arrive in."""
    lines = spark.readStream.text(folder)
    return lines.select(*parse_line(lines["value"]).values()).where("map IS NOT NULL")


def stuck(ticks: DataFrame, key: str = "user_id", order: str = "event_id", limits: tuple[int, int, int] = (STUCK_TICKS, STUCK_OCTANTS, REST_TICKS)) -> DataFrame:
    """As the batch operator, with the state of each player kept between micro-batches."""

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = Detector(*(state.get if state.exists else (0, 0)), limits)
        out = []
        for row in pd.concat(batches).sort_values(order).itertuples():
            if octants := detector.step(row.pushing, row.slow, row.ang):
                out.append((who[0], getattr(row, order), octants))
        state.update((detector.ticks, detector.mask))
        yield pd.DataFrame(out, columns=[key, order, "octants"])

    return ticks.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, octants int", "ticks int, mask int", "append", GroupStateTimeout.NoTimeout)
