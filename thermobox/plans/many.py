"""Budgets of many boxes over one state, in the two scans that a single box takes.

Boxes may overlap. A cell is joined with the boxes that hold it, first by latitude, then by longitude, and its terms are
summed by box and hour; a pair of cells is joined with the walls it lies on. Boxes that reach the ground and boxes with a
bottom level have other faces and are taken apart. What is broadcast are the boxes' own latitudes, longitudes and
wall pieces, which the caller's requests bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.functions.columns import cell_area, seconds_between
from thermobox.operators.domain import Box, lat_rows, lon_rows, piece_rows, resolve_boxes
from thermobox.operators.series import index_by, with_neighbours
from thermobox.operators.volume import moment_sums, require_level, with_air
from thermobox.operators.walls import piece_faces, wall_sums
from thermobox.plans.budget import BUDGET_FIELDS, RATES_OF, budget_terms, signed_terms, temperature_spread
from thermobox.sources.state import GridState, grid_key
from thermobox.specs import BoxRequest, BoxSpec, SurfacePolicy

_SPEC = [("run", pa.string()), ("top_pressure", pa.float64()), ("bottom_pressure", pa.float64())]
_LATS = pa.schema([*_SPEC, ("lat_key", pa.int64()), ("d_sin", pa.float64())])
_LONS = pa.schema([("run", pa.string()), ("lon_key", pa.int64()), ("d_lon", pa.float64())])
_PIECES = pa.schema([
    *_SPEC, ("piece", pa.int64()), ("wall", pa.string()), ("along_id", pa.int64()), ("span", pa.float64()), ("cells", pa.list_(pa.int64())),
])
CARRIED = tuple(name for name, _ in _SPEC)


class BoxSet:
    """Boxes with the same faces on one grid, by name, as tables."""

    def __init__(self, boxes: Mapping[str, Box]):
        self.boxes = dict(boxes)
        self.any = next(iter(self.boxes.values()))
        for box in self.boxes.values():
            for pressure in (box.spec.top_pressure, box.spec.bottom_pressure):
                if pressure is not None:
                    require_level(box.level_values, pressure)

    @property
    def spec(self) -> BoxSpec:
        """The faces, with the pressures as columns of CARRIED."""
        bottom = F.col("bottom_pressure") if self.any.spec.closed_below else None
        return replace(self.any.spec, top_pressure=F.col("top_pressure"), bottom_pressure=bottom)

    def _rows(self, of, schema: pa.Schema, keep) -> DataFrame:
        out = []
        for run, box in self.boxes.items():
            spec = dict(run=run, top_pressure=box.spec.top_pressure, bottom_pressure=box.spec.bottom_pressure)
            out += [{**spec, **row} for row in of(box) if keep(row)]
        for number, row in enumerate(out):
            row["piece"] = number
        picked = [{name: row[name] for name in schema.names} for row in out]
        return self.any.spark.createDataFrame(pa.Table.from_pylist(picked, schema=schema))

    def lats(self) -> DataFrame:
        return self._rows(lat_rows, _LATS, lambda r: r["lat_in"])

    def lons(self) -> DataFrame:
        return self._rows(lon_rows, _LONS, lambda r: r["lon_in"])

    def pieces(self) -> DataFrame:
        return self._rows(piece_rows, _PIECES, lambda r: True)

    def hull(self, state: GridState) -> GridState:
        """The range of places that the boxes and their halos span, as literals for the scan."""
        keep = F.lit(True)
        for axis in ("lat", "lon"):
            values = [p.value for box in self.boxes.values() for p in getattr(box, f"{axis}_points")]
            keep = keep & F.col(axis).between(min(values), max(values))
            if state.tiling is not None:
                keep = keep & state.tiling.between(axis, min(values), max(values))
        return state.restrict(keep)

    def beside(self, state: GridState) -> GridState:
        """Of these, the latitudes and longitudes next to a wall of any box."""
        near = []
        for axis in ("lat", "lon"):
            values = {getattr(box, f"{axis}_points")[i].value for box in self.boxes.values() for i in (0, 1, -2, -1)}
            near.append(F.col(axis).isin(*values))
        return self.hull(state).restrict(near[0] | near[1])


def box_moments(state: GridState, boxes: BoxSet, policy: SurfacePolicy) -> DataFrame:
    """run, time and all sums that a budget needs."""
    keys = ("run", "time")
    rows = boxes.hull(state).rows(("T", "w"), ("sp",)).withColumns({"lat_key": grid_key("lat"), "lon_key": grid_key("lon")})
    placed = rows.join(F.broadcast(boxes.lats()), "lat_key").join(F.broadcast(boxes.lons()), ["run", "lon_key"])
    cells = boxes.any.attach(placed, "level", "level_id", "p_start", "p_end", "dp").withColumn("area", cell_area(F.col("d_sin"), F.col("d_lon")))
    volume = moment_sums(with_air(cells, boxes.spec, policy), boxes.spec, boxes.any.level_values, keys=keys)
    faces = piece_faces(boxes.beside(state), boxes.any, boxes.pieces(), boxes.spec, policy, CARRIED)
    return volume.join(wall_sums(faces, keys=keys), list(keys))


def _budgets(state: GridState, boxes: BoxSet, policy: SurfacePolicy) -> DataFrame:
    series = index_by(box_moments(state, boxes, policy), "run", ("time",))
    scale = temperature_spread(series.frame, "run")
    signed = series.map(signed_terms(series.frame, boxes.spec))
    around = {f"{side}_{name}": (shift, name) for name in ("time", *RATES_OF.values()) for side, shift in (("before", -1), ("after", 1))}
    near = with_neighbours(signed, around, "run").where("before_time IS NOT NULL AND after_time IS NOT NULL")
    elapsed = seconds_between(F.col("before_time"), F.col("after_time"), False)

    def rate(name: str) -> Column:
        return F.try_divide(F.col(f"after_{name}") - F.col(f"before_{name}"), elapsed)

    rates = near.withColumns({out: rate(name) for out, name in RATES_OF.items()}).join(F.broadcast(scale), "run")  # one row per box
    return budget_terms(rates).select("run", "time", *BUDGET_FIELDS)


def run_budgets(state: GridState, requests: Mapping[str, BoxRequest], policy: SurfacePolicy = SurfacePolicy()) -> DataFrame:
    """run, time and the 11 fields of the budget of each named request; boxes may overlap."""
    resolved = resolve_boxes(state, requests)
    groups: Sequence[dict[str, Box]] = [
        {run: box for run, box in resolved.items() if box.spec.closed_below == closed} for closed in (False, True)
    ]
    tables = [_budgets(state, BoxSet(group), policy) for group in groups if group]
    if not tables:
        raise ValueError("no box is requested")
    return reduce(DataFrame.unionByName, tables)
