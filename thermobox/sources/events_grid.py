"""A gridded state cut from the `events` table.

Event ids are dense from 0. Each run of 100 ids is one hour of 4 levels x 5
latitudes x 5 longitudes; the fields are integer rules of the id plus `value`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermobox.sources.state import SURFACE_KEYS, UPPER_FIELDS, UPPER_KEYS, GridState

# The rule of each column.
_POINT = (
    "event_id",
    "value",
    "CAST((event_id DIV 25) % 4 AS int) AS layer",
    "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(event_id DIV 100 AS int), 0, 0) AS time",
    "CAST(100000 - 10000 * ((event_id DIV 25) % 4) AS double) AS level",
    "CAST(40 + 5 * ((event_id DIV 5) % 5) AS double) AS lat",
    "CAST(-130 + 5 * (event_id % 5) AS double) AS lon",
    "CAST(300 - 8 * ((event_id DIV 25) % 4) AS double) + value / 64D AS T",
    "((event_id * 7919) % 1009) / 100D - 5D AS u",
    "((event_id * 104729) % 997) / 100D - 5D AS v",
    "((event_id * 1299709) % 883) / 4000D - 0.1D AS w",
    "CAST(84000 + 100 * ((event_id * 37) % 231) AS double) AS sp",
    "285D + value / 32D AS T2m",
    "(((event_id * 7919) % 1009) / 100D - 5D) / 2D AS u10",
    "(((event_id * 104729) % 997) / 100D - 5D) / 2D AS v10",
)


def gridded_events(events: DataFrame) -> DataFrame:
    """Every event as one grid point, with its source position `event_id`."""
    return events.selectExpr(*_POINT)


def events_state(spark: SparkSession, sf_dir: str) -> GridState:
    points = gridded_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    upper = points.select(*UPPER_KEYS, *UPPER_FIELDS)
    surface = points.where("layer = 0").select(*SURFACE_KEYS, "sp", "T2m", "u10", "v10")
    return GridState(upper, surface)
