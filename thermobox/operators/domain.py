"""Axes, cell geometry and the resolution of a request to whole cells.

The coordinates of the box, and all levels, are the one thing read eagerly: they give
the literal bounds for the scan and the dimension tables. Snapping is one aggregate over the
coordinates, so a small box on a large grid brings only its own to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermobox.functions.columns import cell_area
from thermobox.operators.axes import Tiling, coordinate_axes
from thermobox.sources.state import GridState, grid_key
from thermobox.specs import EARTH_RADIUS, BoxRequest, BoxSpec


@dataclass(frozen=True)
class Cell:
    """A cell of an axis: of latitude and longitude from its start to the next, of levels around its centre."""

    id: int
    value: float
    lower_edge: float
    upper_edge: float

    @property
    def key(self) -> int:
        return math.floor(self.value * 1e6 + 0.5)

    @property
    def middle(self) -> float:
        return 0.5 * (self.lower_edge + self.upper_edge)

    @property
    def width(self) -> float:
        return abs(self.upper_edge - self.lower_edge)

    @property
    def radians(self) -> float:
        return abs(math.radians(self.upper_edge) - math.radians(self.lower_edge))

    @property
    def d_sin(self) -> float:
        return abs(math.sin(math.radians(self.upper_edge)) - math.sin(math.radians(self.lower_edge)))


@dataclass(frozen=True)
class AxisPoints:
    """Size and range of an axis, and of its coordinates those that a request needs, `first` being the index of the first one."""

    n: int
    low: float
    high: float
    first: int
    values: tuple[float, ...]

    @property
    def too_close(self) -> bool:
        keys = [math.floor(v * 1e6 + 0.5) for v in self.values]
        return any(a == b for a, b in zip(keys, keys[1:]))


_LEVEL_SCHEMA = pa.schema(
    [("level", pa.float64()), ("level_key", pa.int64()), ("level_id", pa.int64())]
    + [(name, pa.float64()) for name in ("p_start", "p_end", "p_mid", "dp")]
    + [(name, pa.float64()) for name in ("below_start", "below_end", "below_mid")]
    + [("is_top", pa.bool_())]
)
_LAT_SCHEMA = pa.schema(
    [("lat", pa.float64()), ("lat_key", pa.int64()), ("lat_id", pa.int64())]
    + [(name, pa.float64()) for name in ("lat_start", "lat_end", "lat_mid", "d_phi", "d_sin")]
    + [("lat_in", pa.bool_())]
)
_PIECE_SCHEMA = pa.schema([
    ("piece", pa.int64()), ("wall", pa.string()), ("along_id", pa.int64()), ("span", pa.float64()),
    ("cells", pa.list_(pa.int64())),
])
_LON_SCHEMA = pa.schema(
    [("lon", pa.float64()), ("lon_key", pa.int64()), ("lon_id", pa.int64())]
    + [(name, pa.float64()) for name in ("lon_start", "lon_end", "lon_mid", "d_lon")]
    + [("lon_in", pa.bool_())]
)


@dataclass(frozen=True)
class Box:
    """A resolved request: spec, all layers, and the cells of the halo (domain and one ring) along each axis."""

    spec: BoxSpec
    spark: SparkSession = field(repr=False, compare=False)
    level_cells: tuple[Cell, ...] = field(repr=False)
    lat_points: tuple[Cell, ...] = field(repr=False)
    lon_points: tuple[Cell, ...] = field(repr=False)

    @cached_property
    def levels(self) -> DataFrame:
        rows = [
            dict(level=r.value, level_key=r.key, level_id=r.id, p_start=r.lower_edge, p_end=r.upper_edge, p_mid=r.value, dp=r.width,
                 below_start=below and below.lower_edge, below_end=below and below.upper_edge,
                 below_mid=below and below.value, is_top=r is self.level_cells[-1])
            for below, r in zip([None, *self.level_cells], self.level_cells)
        ]
        return _table(self.spark, rows, _LEVEL_SCHEMA)

    @cached_property
    def lats(self) -> DataFrame:
        return _table(self.spark, lat_rows(self), _LAT_SCHEMA)

    @cached_property
    def lons(self) -> DataFrame:
        return _table(self.spark, lon_rows(self), _LON_SCHEMA)

    @property
    def level_values(self) -> tuple[float, ...]:
        return tuple(r.value for r in self.level_cells)

    @property
    def layers(self) -> tuple[tuple[float, float, float], ...]:
        return tuple((r.lower_edge, r.upper_edge, r.value) for r in self.level_cells)

    @property
    def halo_edges(self) -> tuple[float, float, float, float]:
        return (self.lat_points[0].lower_edge, self.lat_points[-1].upper_edge,
                self.lon_points[0].lower_edge, self.lon_points[-1].upper_edge)

    @property
    def lowest_level(self) -> float:
        return self.level_values[0]

    def _between(self, skip: int) -> Column:
        bounds = [
            F.col(axis).between(points[skip].value, points[-1 - skip].value)
            for axis, points in (("lat", self.lat_points), ("lon", self.lon_points))
        ]
        return bounds[0] & bounds[1]

    def halo_filter(self) -> Column:
        """Literal ranges that reach the parquet scan."""
        return self._between(0)

    def domain_filter(self) -> Column:
        return self._between(1)

    def ring_filter(self) -> Column:
        """The rows and columns of cells next to a side wall, as literals for the scan."""
        near = [
            F.col(axis).isin(*self._beside(points))
            for axis, points in (("lat", self.lat_points), ("lon", self.lon_points))
        ]
        return self.halo_filter() & (near[0] | near[1])

    def attach(self, df: DataFrame, axis: str, *columns: str) -> DataFrame:
        """Add columns of one dimension table to rows that have the coordinate."""
        table = {"level": self.levels, "lat": self.lats, "lon": self.lons}[axis]
        key = f"{axis}_key"
        small = F.broadcast(table.select(key, *columns))
        return df.join(small, grid_key(axis) == F.col(key)).drop(key)

    def _tiles(self, tiling: Tiling | None, skip: int) -> Column:
        """The tiles that hold the rows of `_between`, where the state has tiles."""
        if tiling is None:
            return F.lit(True)
        return tiling.between("lat", self.lat_points[skip].value, self.lat_points[-1 - skip].value) & tiling.between(
            "lon", self.lon_points[skip].value, self.lon_points[-1 - skip].value)

    def crop(self, state: GridState) -> GridState:
        """The halo."""
        return state.restrict(self._tiles(state.tiling, 0) & self.halo_filter())

    def domain(self, state: GridState) -> GridState:
        return state.restrict(self._tiles(state.tiling, 1) & self.domain_filter())

    def ring(self, state: GridState) -> GridState:
        """The cells next to a side wall."""
        near = F.lit(True)
        if state.tiling is not None:
            near = state.tiling.any_of("lat", self._beside(self.lat_points)) | state.tiling.any_of("lon", self._beside(self.lon_points))
        return state.restrict(self._tiles(state.tiling, 0) & near & self.ring_filter())

    @staticmethod
    def _beside(points: tuple[Cell, ...]) -> set[float]:
        return {points[i].value for i in (0, 1, -2, -1)}


def lat_rows(box: Box) -> list[dict]:
    points = box.lat_points
    return [
        dict(lat=r.value, lat_key=r.key, lat_id=r.id, lat_start=r.lower_edge, lat_end=r.upper_edge, lat_mid=r.middle,
             d_phi=r.radians, d_sin=r.d_sin, lat_in=r not in (points[0], points[-1]))
        for r in points
    ]


def lon_rows(box: Box) -> list[dict]:
    points = box.lon_points
    return [
        dict(lon=r.value, lon_key=r.key, lon_id=r.id, lon_start=r.lower_edge, lon_end=r.upper_edge, lon_mid=r.middle,
             d_lon=r.radians, lon_in=r not in (points[0], points[-1]))
        for r in points
    ]


def _table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def _inside(name: str, axis: AxisPoints, low: float, high: float) -> None:
    if low < axis.low or high > axis.high:
        raise ValueError(f"requested {name} range is outside the grid")


_BOUNDS_SCHEMA = pa.schema([("run", pa.string()), ("axis", pa.string()), ("from", pa.float64()), ("to", pa.float64())])


def axis_points(axes: DataFrame, requests: Mapping[str, BoxRequest]) -> dict[str, dict[str, AxisPoints]]:
    """Per request and axis: of lat and lon the starts of the touched cells and the one that closes the last, of level all, highest first.

    One aggregate over the coordinates. A touched cell starts at the last start at or before the box, or inside it.
    """
    bounds = []
    for run, request in requests.items():
        lat0, lat1, lon0, lon1 = (float(edge) for edge in request.bbox)
        bounds += [{"run": run, "axis": a, "from": low, "to": high} for a, low, high in
                   (("level", None, None), ("lat", lat0, lat1), ("lon", lon0, lon1))]
    value, low, high = F.col("value"), F.col("from"), F.col("to")
    inside = (F.col("axis") == "level") | ((value > low) & (value < high))
    asked = F.broadcast(_table(axes.sparkSession, bounds, _BOUNDS_SCHEMA))  # three rows per request
    found = axes.join(asked, "axis").groupBy("run", "axis").agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(value <= low).alias("before"),
        F.max(F.when(value <= low, value)).alias("start"), F.min(F.when(value >= high, value)).alias("stop"),
        F.collect_set(F.when(inside, value)).alias("inside"),
    )
    out: dict[str, dict[str, AxisPoints]] = {run: {} for run in requests}
    for r in found.collect():
        values = set(r["inside"]) | {v for v in (r["start"], r["stop"]) if v is not None}
        ordered = tuple(sorted(values, reverse=r["axis"] == "level"))
        out[r["run"]][r["axis"]] = AxisPoints(r["n"], r["low"], r["high"], max(0, r["before"] - 1), ordered)
    return out


def _halo(points: AxisPoints, margin: int) -> list[Cell]:
    """The cells of the domain, `margin` within the touched ones, and one on either side."""
    touched = [Cell(points.first + i, a, a, b) for i, (a, b) in enumerate(zip(points.values, points.values[1:]))]
    if len(touched) - 2 * margin < 1:
        raise ValueError("domain too small after snapping to cells and applying the margin")
    return touched[margin - 1:len(touched) - margin + 1]


def _layers(levels: tuple[float, ...]) -> list[Cell]:
    """Layers around the levels: inner edges halfway, the outer two half a step outside."""
    inner = [0.5 * (a + b) for a, b in zip(levels, levels[1:])]
    edges = [levels[0] - 0.5 * (levels[1] - levels[0]), *inner, levels[-1] + 0.5 * (levels[-1] - levels[-2])]
    return [Cell(i, p, lower, upper) for i, (p, lower, upper) in enumerate(zip(levels, edges, edges[1:]))]


def resolve_box(state: GridState, request: BoxRequest, axes: DataFrame | None = None) -> Box:
    """Snap the request to the grid. One small Spark job over the key columns.

    Known coordinates, given here or with the state, save that scan.
    """
    return resolve_boxes(state, {"": request}, axes)[""]


def resolve_boxes(state: GridState, requests: Mapping[str, BoxRequest], axes: DataFrame | None = None) -> dict[str, Box]:
    """All requests, by name, snapped in the same job."""
    if axes is None:
        axes = coordinate_axes(state.upper) if state.axes is None else state.axes
    points = axis_points(axes, requests)
    return {run: _snapped(state.upper.sparkSession, points[run], request) for run, request in requests.items()}


def refusals(state: GridState, requests: Mapping[str, BoxRequest]) -> DataFrame:
    """run, reason: why a request cannot be met on this grid; NULL where it can. One job for all requests."""
    axes = coordinate_axes(state.upper) if state.axes is None else state.axes
    points, rows = axis_points(axes, requests), []
    for run, request in requests.items():
        try:
            _snapped(state.upper.sparkSession, points[run], request)
            rows.append((run, None))
        except ValueError as error:
            rows.append((run, str(error)))
    return state.upper.sparkSession.createDataFrame(rows, "run string, reason string")


def _snapped(spark: SparkSession, by_axis: dict[str, AxisPoints], request: BoxRequest) -> Box:
    for name in ("level", "lat", "lon"):
        if name not in by_axis or by_axis[name].n < 2:
            raise ValueError(f"axis {name} needs at least two points")
        if by_axis[name].too_close:
            raise ValueError(f"axis {name} has points closer than a millionth")

    lats, lons = by_axis["lat"], by_axis["lon"]
    if any(points.n - 1 - 2 * request.margin <= 0 for points in (lats, lons)):
        raise ValueError("margin is too large for this grid")
    lat0, lat1, lon0, lon1 = (float(edge) for edge in request.bbox)
    _inside("latitude", lats, lat0, lat1)
    _inside("longitude", lons, lon0, lon1)
    levels = _layers(by_axis["level"].values)
    _check_pressures(request, by_axis["level"].values)
    halo_lats, halo_lons = _halo(lats, request.margin), _halo(lons, request.margin)

    spec = BoxSpec(
        lat=(halo_lats[1].lower_edge, halo_lats[-2].upper_edge),
        lon=(halo_lons[1].lower_edge, halo_lons[-2].upper_edge),
        top_pressure=float(request.top_pressure),
        bottom_pressure=None if request.bottom_pressure is None else float(request.bottom_pressure),
    )
    return Box(spec, spark, tuple(levels), tuple(halo_lats), tuple(halo_lons))


def _check_pressures(request: BoxRequest, level_values: Sequence[float]) -> None:
    if request.bottom_pressure is None:
        return
    lowest, highest = min(level_values), max(level_values)
    for name, pressure in (("bottom", request.bottom_pressure), ("top", request.top_pressure)):
        if not lowest <= pressure <= highest:
            raise ValueError(f"requested {name} pressure is outside the level range")
    if request.top_pressure >= request.bottom_pressure:
        raise ValueError("the top pressure must be less than the bottom pressure")


def halo_cells(box: Box) -> DataFrame:
    """All halo cells with their bounds and `in_domain`.

    Latitudes are paired with longitude ids by an equi-join, bounded by the axes.
    """
    ids = F.explode(F.sequence(F.lit(box.lon_points[0].id), F.lit(box.lon_points[-1].id)))
    return (
        box.lats.withColumn("lon_id", ids)
        .join(F.broadcast(box.lons), "lon_id")
        .withColumn("in_domain", F.col("lat_in") & F.col("lon_in"))
    )


def horizontal_areas(box: Box) -> DataFrame:
    """Horizontal area of each domain cell, m2."""
    return (
        halo_cells(box)
        .where("in_domain")
        .select("lat_id", "lon_id", "lat_mid", "lon_mid",
                cell_area(F.col("d_sin"), F.col("d_lon")).alias("area"))
    )


def cell_volumes(box: Box) -> DataFrame:
    """Volume of each domain cell, m2 Pa."""
    count = len(box.level_values)
    return (
        horizontal_areas(box)
        .withColumn("level_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .join(F.broadcast(box.levels.select("level_id", "level", "dp")), "level_id")
        .select("level_id", "lat_id", "lon_id", (F.col("area") * F.col("dp")).alias("volume"))
    )


def _zonal_factors(box: Box) -> tuple[float, float]:
    """R cos(lat) of the south and north walls, at the outer edges of the halo.

    Not at the walls' own latitudes: the results to match are defined this way.
    """
    south, north, _, _ = box.halo_edges
    return EARTH_RADIUS * math.cos(math.radians(south)), EARTH_RADIUS * math.cos(math.radians(north))


def wall_pieces(box: Box) -> DataFrame:
    """Pieces of the four side walls at positions of the domain: piece, wall, along_id, span (m).

    `cells` holds the keys of the two cells astride. At most 2 x the axis lengths.
    """
    return _table(box.spark, piece_rows(box), _PIECE_SCHEMA)


def piece_rows(box: Box) -> list[dict]:
    south, north = _zonal_factors(box)
    lats, lons = box.lat_points, box.lon_points
    walls = (
        ("west", EARTH_RADIUS, lats, lons[:2]),
        ("east", EARTH_RADIUS, lats, lons[-2:]),
        ("south", south, lons, lats[:2]),
        ("north", north, lons, lats[-2:]),
    )
    pieces = []
    for wall, factor, positions, astride in walls:
        for point in positions[1:-1]:
            pairs = [(point, cell) if positions is lats else (cell, point) for cell in astride]
            pieces.append(dict(
                piece=len(pieces), wall=wall, along_id=point.id, span=factor * point.radians,
                cells=[lat.key * CELL_KEY_BASE + lon.key for lat, lon in pairs],
            ))
    return pieces


CELL_KEY_BASE = 1 << 32


def cell_key() -> Column:
    """lat and lon of a row in one integer, as in the `cells` of wall_pieces."""
    return grid_key("lat") * F.lit(CELL_KEY_BASE) + grid_key("lon")


def wall_cells(pieces: DataFrame) -> DataFrame:
    """cell_key -> piece, two rows per piece."""
    return pieces.select(F.explode("cells").alias("cell_key"), "piece")


def wall_areas(box: Box) -> DataFrame:
    """Area of each wall piece of the halo, m Pa, by (wall, level_id, along_id).

    All positions of the halo are given, as the geometry is defined there; integrals use
    the positions of the domain.
    """
    south, north = _zonal_factors(box)
    spans = box.lats.selectExpr(
        "lat_id AS along_id", f"inline(array(struct('west' AS wall, {EARTH_RADIUS}D * d_phi AS span),"
        f" struct('east' AS wall, {EARTH_RADIUS}D * d_phi AS span)))",
    ).unionByName(box.lons.selectExpr(
        "lon_id AS along_id", f"inline(array(struct('south' AS wall, {south!r}D * d_lon AS span),"
        f" struct('north' AS wall, {north!r}D * d_lon AS span)))",
    ))
    levels = F.sequence(F.lit(0), F.lit(len(box.level_values) - 1))
    return (
        spans.withColumn("level_id", F.explode(levels))
        .join(F.broadcast(box.levels.select("level_id", "dp")), "level_id")
        .select("wall", "level_id", "along_id", (F.col("dp") * F.col("span")).alias("area"))
    )
