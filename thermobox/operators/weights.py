"""How much of each cell, wall piece and horizontal face lies above the ground."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermobox.functions.columns import (
    cell_area,
    effective_bottom,
    layer_weight,
    open_face,
)
from thermobox.operators.domain import Box, cell_key, wall_cells, wall_pieces
from thermobox.sources.state import GridState
from thermobox.specs import BoxSpec, SurfacePolicy


def weight_column(spec: BoxSpec, policy: SurfacePolicy, bottom: str = "bottom"):
    """Weight of a layer from level_id, p_start, p_end and a bottom pressure column."""
    return layer_weight(
        F.col("level_id"), F.col("p_start"), F.col("p_end"), F.col(bottom), spec, policy
    )


def with_cell_area(state: GridState, box: Box) -> GridState:
    """Add `area` (m2), lat_id and lon_id to the rows that carry the ground pressure."""

    def with_area(df: DataFrame) -> DataFrame:
        df = box.attach(box.attach(df, "lat", "lat_id", "d_sin"), "lon", "lon_id", "d_lon")
        return df.withColumn("area", cell_area(F.col("d_sin"), F.col("d_lon"))).drop("d_sin", "d_lon")

    if state.wide:
        return replace(state, upper=with_area(state.upper))
    return replace(state, surface=with_area(state.surface))


def horizontal_weights(state: GridState, box: Box) -> DataFrame:
    """W_top, and W_bottom where the box has a bottom face, per time and domain cell."""
    spec = box.spec
    faces = [open_face(F.col("sp"), spec.top_pressure).alias("W_top")]
    if spec.closed_below:
        faces.append(open_face(F.col("sp"), spec.bottom_pressure).alias("W_bottom"))
    inside = with_cell_area(box.domain(state), box)
    ground = inside.ground(["sp", "lat_id", "lon_id"], box.lowest_level)
    return ground.select("time", "lat_id", "lon_id", *faces)


def volume_weights(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """W_volume per time, level and domain cell."""
    inside = with_cell_area(box.domain(state), box)
    rows = inside.rows([], ["sp", "lat_id", "lon_id"])
    return (
        box.attach(rows, "level", "level_id", "p_start", "p_end")
        .withColumn("bottom", effective_bottom(F.col("sp"), box.spec))
        .select("time", "level_id", "lat_id", "lon_id", weight_column(box.spec, policy).alias("W_volume"))
    )


def wall_bottoms(state: GridState, box: Box) -> DataFrame:
    """Bottom pressure at each wall position: the mean of the two cells astride the wall."""
    pieces = wall_pieces(box)
    ground = box.ring(state).ground(["sp"], box.lowest_level)
    return (
        ground.select("time", cell_key().alias("cell_key"), effective_bottom(F.col("sp"), box.spec).alias("bottom"))
        .join(F.broadcast(wall_cells(pieces)), "cell_key")
        .groupBy("time", "piece")
        .agg(pair_mean("bottom"))
        .join(F.broadcast(pieces.select("piece", "wall", "along_id")), "piece")
        .drop("piece")
    )


def pair_mean(name: str):
    """Mean of the two cells astride a wall; missing when one of them is."""
    return F.expr(f"if(count({name}) = 2, 0.5D * sum({name}), NULL)").alias(name)


def wall_weights(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """Weight of each wall piece per time, wall, level and position along the wall."""
    count = len(box.level_values)
    return (
        wall_bottoms(state, box)
        .withColumn("level_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .join(F.broadcast(box.levels), "level_id")
        .select("time", "wall", "level_id", "along_id", weight_column(box.spec, policy).alias("W_wall"))
    )
