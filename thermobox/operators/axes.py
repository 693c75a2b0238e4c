"""Coordinates as tables: numbering, neighbours, cell edges and tiles without a window over a whole axis.

An axis can be long (irregular places have as many coordinates as rows), so nothing here puts one into a
task or on the driver: coordinates are numbered by range partitions and offsets, neighbours meet in
blocks of consecutive numbers, and ranges are plain aggregates.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.operators.series import index_by, with_neighbours
from thermobox.specs import BoxRequest


def coordinate_axes(upper: DataFrame) -> DataFrame:
    """Distinct coordinates as (axis, value), in one scan of the three key columns."""
    return (
        upper.selectExpr(
            "stack(3, 'level', cast(level AS double), 'lat', cast(lat AS double), 'lon', cast(lon AS double)) AS (axis, value)"
        )
        .where("value IS NOT NULL")
        .distinct()
    )


def numbered(points: DataFrame, order: str) -> DataFrame:
    """`points` (axis, value, ...) with id, the place on the axis by `order` from 0, and before and after, the values next to it."""
    series = index_by(points, "axis", (order,))
    first = series.frame.groupBy("axis").agg(F.min("step").alias("first"))  # one row per axis
    found = with_neighbours(series, {"before": (-1, "value"), "after": (1, "value")}, "axis")
    return found.join(F.broadcast(first), "axis").withColumn("id", F.col("step") - F.col("first")).drop("step", "first")


def measure_axes(axes: DataFrame, request: BoxRequest | None = None) -> DataFrame:
    """Give each coordinate its index, key, edges, middle and angular widths.

    Levels are centres, counted from the highest pressure: inner edges lie halfway, the
    two outer ones half a step outside. Latitudes and longitudes are cell starts: a cell
    reaches to the next start, so the last start has no cell (its `upper_edge` is NULL).
    `covered` marks the cells the requested box touches.
    """
    covered = "cast(NULL AS boolean)"
    if request is not None:
        lat0, lat1, lon0, lon1 = (float(edge) for edge in request.bbox)
        covered = (
            f"CASE axis WHEN 'lat' THEN upper_edge > {lat0}D AND lower_edge < {lat1}D"
            f" WHEN 'lon' THEN upper_edge > {lon0}D AND lower_edge < {lon1}D ELSE true END"
        )
    along = axes.select("axis", "value", F.expr("if(axis = 'level', -value, value)").alias("along"))
    return (
        numbered(along, "along")
        .selectExpr(
            "axis", "value", "id",
            "floor(value * 1e6D + 0.5D) AS key",
            "if(axis = 'level', coalesce(0.5D * (before + value), value - 0.5D * (after - value)), value) AS lower_edge",
            "if(axis = 'level', coalesce(0.5D * (value + after), value + 0.5D * (value - before)), after) AS upper_edge",
        )
        .selectExpr(
            "*",
            "if(axis = 'level', value, 0.5D * (lower_edge + upper_edge)) AS middle",
            "abs(upper_edge - lower_edge) AS width",
            "if(axis = 'level', NULL, abs(radians(upper_edge) - radians(lower_edge))) AS radians",
            "if(axis = 'lat', abs(sin(radians(upper_edge)) - sin(radians(lower_edge))), NULL) AS d_sin",
            f"{covered} AS covered",
        )
    )


def order_breaks(points: DataFrame, order: str) -> DataFrame:
    """axis, n_bad: coordinates that stand, by `order`, after one they should precede. Levels must fall, the others rise."""
    step = F.col("value") - F.col("before")
    wrong = F.when(F.col("axis") == "level", step >= 0).otherwise(step <= 0)
    return numbered(points, order).groupBy("axis").agg(F.count_if(wrong).alias("n_bad"))


@dataclass(frozen=True)
class Tiling:
    """Starts of the tiles along latitude and longitude, rising; a tile reaches to the next start, the outer ones have no end.

    Where a tile has few rows, `monthly`, its folders hold a month each instead of a day.
    """

    lat: tuple[float, ...]
    lon: tuple[float, ...]
    monthly: bool = False

    def number(self, axis: str, value: float) -> int:
        return max(0, bisect.bisect_right(getattr(self, axis), value) - 1)

    def column(self, axis: str) -> Column:
        """Tile of the row's coordinate, by halving: as many comparisons as the number of tiles has digits."""
        starts, value = getattr(self, axis), F.col(axis)

        def within(first: int, last: int) -> Column:
            if last - first <= 1:
                return F.lit(first)
            middle = (first + last) // 2
            return F.when(value < F.lit(starts[middle]), within(first, middle)).otherwise(within(middle, last))

        return within(0, max(1, len(starts))).cast("int")

    def folders(self) -> dict[str, Column]:
        """The columns that say in which folder a row lies; monthly ones start on `date`, and the row keeps its `day`."""
        day = F.to_date("time")
        dates = {"date": F.trunc(day, "month"), "day": day} if self.monthly else {"date": day}
        return {**dates, "tile_lat": self.column("lat"), "tile_lon": self.column("lon")}

    def between(self, axis: str, low: float, high: float) -> Column:
        return F.col(f"tile_{axis}").between(self.number(axis, low), self.number(axis, high))

    def any_of(self, axis: str, values: set[float]) -> Column:
        return F.col(f"tile_{axis}").isin(*{self.number(axis, v) for v in values})


def tile_starts(axes: DataFrame, points: int, most: int) -> DataFrame:
    """axis, tile, start: every `points`-th latitude and longitude, or as many more that an axis has at most `most` tiles."""
    sides = axes.where("axis <> 'level'").select("axis", "value", F.col("value").alias("along"))
    places = numbered(sides, "along")
    span = F.greatest(F.lit(points), F.ceil((F.max("id") + 1) / most))
    wide = F.broadcast(places.groupBy("axis").agg(span.alias("span")))  # one row per axis
    first = places.join(wide, "axis").where(F.col("id") % F.col("span") == 0)
    return first.select("axis", F.expr("int(id div span)").alias("tile"), F.col("value").alias("start"))


def rows_per_hour(axes: DataFrame, points: int, most: int) -> int:
    """The most rows an hour has in one of the tiles that `tile_starts` makes."""
    sizes = {r["axis"]: r["count"] for r in axes.groupBy("axis").count().collect()}  # three numbers
    sides = [min(n, max(points, math.ceil(n / most))) for n in (sizes.get("lat", 0), sizes.get("lon", 0))]
    return sizes.get("level", 0) * sides[0] * sides[1]
