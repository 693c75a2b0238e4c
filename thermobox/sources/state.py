"""The gridded state: a 4-D table and the ground table that belongs to it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.operators.axes import Tiling

# Names of the keys and fields.
UPPER_KEYS = ("time", "level", "lat", "lon")
SURFACE_KEYS = ("time", "lat", "lon")
UPPER_FIELDS = ("T", "u", "v", "w")
SURFACE_FIELDS = ("sp",)
NEAR_SURFACE_FIELDS = ("T2m", "u10", "v10")


def grid_key(name: str) -> Column:
    """A coordinate as an integer of millionths: integer keys hash several times faster.

    Coordinates of a grid lie further apart than that; resolving a box checks it.
    """
    return F.expr(f"floor({name} * 1e6D + 0.5D)")


@dataclass(frozen=True)
class GridState:
    """`upper` has time, level, lat, lon, T, u, v, w; `surface` has time, lat, lon, sp and more.

    With `surface=None` the rows of `upper` carry the surface fields themselves. That is
    the layout the writer makes, and it lets a budget run without joining two large tables.
    `axes` (axis, value) are the coordinates where they are known without reading `upper`. With a `tiling`
    the rows carry tile_lat and tile_lon, by which whole files can be left out. `hours` (time) are the hours that a result
    shall have although a box may hold no row of them. `summary` (time, n_rows, n_cells) counts rows and distinct cells per
    hour where the writer has done so.
    """

    upper: DataFrame
    surface: DataFrame | None = None
    axes: DataFrame | None = None
    tiling: Tiling | None = None
    hours: DataFrame | None = None
    summary: DataFrame | None = None

    @property
    def wide(self) -> bool:
        return self.surface is None

    def restrict(self, keep: Column) -> GridState:
        """Filter both tables by a condition on time, lat and lon."""
        surface = None if self.wide else self.surface.where(keep)
        return replace(self, upper=self.upper.where(keep), surface=surface, summary=None)

    def rows(self, fields: Sequence[str], surface_fields: Sequence[str]) -> DataFrame:
        """4-D rows with the ground values of their column.

        The join key is the whole column (time, lat, lon): at most one row per level
        shares it, so no single key can grow heavy however few hours there are.
        """
        columns = [*UPPER_KEYS, *fields]
        if self.wide:
            return self.upper.select(*columns, *surface_fields)
        place = {"_lat": grid_key("lat"), "_lon": grid_key("lon")}
        ground = self.surface.withColumns(place).select("time", "_lat", "_lon", *surface_fields)
        upper = self.upper.select(*columns).withColumns(place)
        return upper.join(ground, ["time", "_lat", "_lon"], "left").drop("_lat", "_lon")

    def ground(self, surface_fields: Sequence[str], lowest_level: float) -> DataFrame:
        """One row per column: time, lat, lon and the ground values."""
        if self.wide:
            source = self.upper.where(F.col("level") == F.lit(float(lowest_level)))
        else:
            source = self.surface
        return source.select(*SURFACE_KEYS, *surface_fields)


def fill_holes(state: GridState, surface_fields: Sequence[str] = SURFACE_FIELDS) -> GridState:
    """A wide state in which every column that the ground table has holds all levels; what was missing is NULL.

    So a missing point counts as a missing value: its volume counts, a layer cut by the ground takes the surface value where
    nothing is known above it, and an hour of which the box holds no row keeps its place in the series. Columns that only
    the upper air has stay as they are, without ground. One join on the whole point.
    """
    if state.wide:
        raise ValueError("the ground table says which columns there are")
    levels = state.upper.select("level").distinct()  # a few dozen
    values = [r["level"] for r in levels.where("level IS NOT NULL").orderBy("level").collect()]
    place = {"_lat": grid_key("lat"), "_lon": grid_key("lon")}
    points = state.surface.select(*SURFACE_KEYS, *surface_fields, F.explode(F.array(*map(F.lit, values))).alias("level"))
    points = points.withColumns(place).withColumnsRenamed({"lat": "_lat0", "lon": "_lon0"})
    upper = state.upper.select(*UPPER_KEYS, *UPPER_FIELDS).withColumns(place)
    rows = upper.join(points, ["time", "_lat", "_lon", "level"], "full_outer")
    filled = rows.select(
        "time", "level", F.coalesce("lat", "_lat0").alias("lat"), F.coalesce("lon", "_lon0").alias("lon"), *UPPER_FIELDS, *surface_fields)
    hours = state.surface.select("time").unionByName(state.upper.select("time")).distinct()
    return GridState(filled, axes=state.axes, hours=hours)
