"""Column expressions shared by the operators. All stay inside codegen.

NULL is the missing value. Spark's greatest/least skip NULL, so every use of
them on pressures is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thermobox.specs import EARTH_RADIUS, BoxSpec, SurfacePolicy


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def total(column: Column) -> Column:
    """Sum that is 0 where no value is present."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180); 180 itself becomes -180."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def cell_area(d_sin: Column, d_lon: Column) -> Column:
    return F.lit(EARTH_RADIUS**2) * d_sin * d_lon


def effective_bottom(sp: Column, spec: BoxSpec) -> Column:
    """Lowest pressure surface of the box in a column: ground, or the bottom level above it."""
    if not spec.closed_below:
        return sp
    return F.when(sp.isNotNull(), F.least(sp, F.lit(spec.bottom_pressure)))


def layer_share(p_start: Column, p_end: Column, top: float | Column, bottom: Column) -> Column:
    """Share of the layer [p_end, p_start] that lies between `top` and `bottom`."""
    inside = F.least(p_start, bottom) - F.greatest(p_end, F.lit(top))
    return F.when(bottom.isNotNull(), F.greatest(F.lit(0.0), inside) / (p_start - p_end))


def layer_weight(
    level_id: Column,
    p_start: Column,
    p_end: Column,
    bottom: Column,
    spec: BoxSpec,
    policy: SurfacePolicy,
) -> Column:
    """Weight of a layer above the effective bottom.

    With overflow the lowest layer reaches down to the ground, may exceed 1, and
    does not look at the top pressure.
    """
    share = layer_share(p_start, p_end, spec.top_pressure, bottom)
    if policy.allow_overflow and not spec.closed_below:
        to_ground = F.greatest(F.lit(0.0), (bottom - p_end) / (p_start - p_end))
        share = F.when(level_id == 0, F.when(bottom.isNotNull(), to_ground)).otherwise(share)
    return share


def open_face(sp: Column, pressure: float | Column) -> Column:
    """1 where the horizontal face at `pressure` is above the ground, else 0, also for unknown ground."""
    return F.when(sp > F.lit(pressure), F.lit(1.0)).otherwise(F.lit(0.0))


def touches_ground(
    level_id: Column, p_start: Column, p_end: Column, sp: Column, policy: SurfacePolicy
) -> Column:
    """True for the layer of a column that the ground cuts (edges excluded)."""
    cut = (sp > p_end) & (sp < p_start)
    if policy.allow_overflow:
        cut = cut | ((level_id == 0) & (sp >= p_start))
    return F.coalesce(cut, F.lit(False))


def ground_case(
    level_id: Column,
    p_start: Column,
    p_end: Column,
    p_mid: Column,
    sp: Column,
    policy: SurfacePolicy,
) -> Column:
    """'B' ground below the layer middle, 'C' ground at or above it, 'A' not touched."""
    touched = touches_ground(level_id, p_start, p_end, sp, policy)
    return F.when(touched & (sp > p_mid), "B").when(touched, "C").otherwise("A")


def blend_with_surface(
    case: Column, value: Column, above: Column, surface: Column, p_end: Column, p_mid: Column, sp: Column
) -> Column:
    """Value a layer carries through a wall once the near-surface value is known."""
    upper = F.greatest(p_mid - p_end, F.lit(0.0))
    lower = F.greatest(sp - p_mid, F.lit(0.0))
    mixed = (upper * value + lower * F.lit(0.5) * (value + surface)) / (upper + lower)
    return (
        F.when(case == "B", mixed)
        .when(case == "C", F.lit(0.5) * (F.coalesce(above, surface) + surface))
        .otherwise(value)
    )


def seconds_between(earlier: Column, later: Column, numeric: bool) -> Column:
    """Elapsed seconds, or the plain difference when time is a number."""
    if numeric:
        return later - earlier
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)
