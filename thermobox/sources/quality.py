"""Schema and grid rules as one report: rule, ok, n_bad."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermobox.operators.axes import coordinate_axes, numbered, order_breaks
from thermobox.operators.series import is_regular
from thermobox.session import materialise, stored
from thermobox.sources.harmonise import unit_of
from thermobox.sources.state import SURFACE_FIELDS, SURFACE_KEYS, UPPER_FIELDS, UPPER_KEYS, GridState, grid_key


@dataclass(frozen=True)
class Axes:
    """Coordinate -> position tables and their sizes. Spark broadcasts those that are small."""

    tables: dict[str, DataFrame]
    sizes: dict[str, int]


def read_axes(state: GridState) -> Axes:
    """Positions on the axes, from the state's own coordinates where it has them."""
    axes = coordinate_axes(state.upper) if state.axes is None else state.axes
    points = stored(numbered(axes.select("axis", "value"), "value").select("axis", grid_key("value").alias("key"), "id"), "axes")
    sizes = {r["axis"]: r["count"] for r in points.groupBy("axis").count().collect()}
    tables = {
        axis: points.where(F.col("axis") == axis).select(F.col("key").alias(f"{axis}_key"), F.col("id").alias(f"{axis}_id"))
        for axis in ("level", "lat", "lon")
    }
    return Axes(tables, {axis: sizes.get(axis, 0) for axis in tables})


def cells_per_time(df: DataFrame, axes: Axes, axis_names: tuple[str, ...]) -> DataFrame:
    """Rows and distinct cells per time: time, n_rows, n_cells.

    Distinct cells are counted exactly, one bit each in words of 64 cells, which fold before the shuffle. A word is a
    number in the buffer of a hash aggregate, so that an hour of a small grid takes a few bytes and large grids leave out empty words.
    """
    cell = F.lit(0).cast("long")
    for axis in axis_names:
        df = df.withColumn(f"{axis}_key", grid_key(axis)).join(axes.tables[axis], f"{axis}_key", "left")
        cell = cell * F.lit(axes.sizes[axis]) + F.col(f"{axis}_id")
    return (
        df.select("time", cell.alias("cell"))
        .groupBy("time", F.expr("cell div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(cell % 64)))").alias("cells"), F.count(F.lit(1)).alias("n_rows"))
        .groupBy("time")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.coalesce(F.sum(F.bit_count("cells").cast("long")), F.lit(0).cast("long")).alias("n_cells"),  # a place off the axes is no cell
        )
    )


def axis_order_breaks(upper: DataFrame, order: str) -> DataFrame:
    """Coordinates out of order in the source: axis, n_bad.

    `order` is the source position of a row; a coordinate stands where it first appears.
    Levels must fall, latitudes and longitudes rise.
    """
    stacked = upper.select(
        order,
        F.expr("stack(3, 'level', cast(level AS double), 'lat', cast(lat AS double),"
               " 'lon', cast(lon AS double)) AS (axis, value)"),
    )
    first_seen = (
        stacked.where(F.col("value").isNotNull())
        .groupBy("axis", "value").agg(F.min(order).alias("seen"))
    )
    return order_breaks(first_seen, "seen")


def _schema_rules(state: GridState) -> list[tuple[str, int]]:
    """Rules on columns, units and types, decided without reading rows."""
    upper_names = set(state.upper.columns)
    surface_names = upper_names if state.wide else set(state.surface.columns)
    dims = [k for k in UPPER_KEYS if k not in upper_names] + [k for k in SURFACE_KEYS if k not in surface_names]
    variables = [v for v in UPPER_FIELDS if v not in upper_names] + [v for v in SURFACE_FIELDS if v not in surface_names]
    return [("dimensions_present", len(dims)), ("variables_present", len(variables))]


def _unit_rule(state: GridState) -> int:
    unit = unit_of(state.upper, "T") if "T" in state.upper.columns else None
    return 0 if unit == "K" else 1


def quality_report(state: GridState, order: str | None = None) -> DataFrame:
    """All rules as rows. When columns are missing, only the column rules are given.

    `order` names a column of the 4-D rows with the source position; without it the
    table has no order of its own and the axis rules hold by sorting. Of a stored state the counts taken while
    it was written serve, and no cell is read.
    """
    spark = state.upper.sparkSession
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("ok", T.BooleanType()),
                           T.StructField("n_bad", T.LongType())])
    fixed = _schema_rules(state)
    if any(bad for _, bad in fixed):
        return spark.createDataFrame([(rule, bad == 0, bad) for rule, bad in fixed], schema)

    axes = read_axes(state)
    counted = cells_per_time(state.upper, axes, UPPER_KEYS[1:]) if state.summary is None else state.summary
    hours = materialise(counted)
    whole = hours.agg(F.sum("n_rows").alias("rows"), F.sum("n_cells").alias("cells"), F.count("time").alias("times")).first()
    rows, cells, times = (whole[name] or 0 for name in ("rows", "cells", "times"))
    n_level, n_lat, n_lon = (axes.sizes[axis] for axis in ("level", "lat", "lon"))
    ground_repeats = ground_missing = 0
    if not state.wide:
        ground = cells_per_time(state.surface, axes, ("lat", "lon"))
        known = ground.join(hours.select("time", F.lit(True).alias("known")), "time", "left")
        found = known.agg(
            F.sum(F.col("n_rows") - F.col("n_cells")).alias("repeats"), F.sum(F.when(F.col("known"), F.col("n_cells"))).alias("cells")
        ).first()
        ground_repeats = found["repeats"] or 0
        ground_missing = times * n_lat * n_lon - (found["cells"] or 0)
    breaks = {} if order is None else {r["axis"]: r["n_bad"] for r in axis_order_breaks(state.upper, order).collect()}
    rules = [
        *fixed,
        ("keys_unique", rows - cells + ground_repeats),
        ("grid_dense", times * n_level * n_lat * n_lon - cells),
        ("ground_dense", ground_missing),
        ("levels_descending", breaks.get("level", 0)),
        ("latitudes_ascending", breaks.get("lat", 0)),
        ("longitudes_ascending", breaks.get("lon", 0)),
        ("temperature_in_kelvin", _unit_rule(state)),
        ("time_regular", is_regular(hours).first()["off_grid"]),
    ]
    return spark.createDataFrame([(rule, bad == 0, bad) for rule, bad in rules], schema)


def validate(state: GridState, order: str | None = None) -> GridState:
    """Return the state, or raise with every broken rule."""
    broken = [f"{r.rule} ({r.n_bad})" for r in quality_report(state, order).collect() if not r.ok]
    if broken:
        raise ValueError("state breaks: " + ", ".join(broken))
    return state
