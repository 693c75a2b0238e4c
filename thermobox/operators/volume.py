"""Integrals over the domain, one row per time.

Everything that needs the whole domain comes out of one pass over (T, w): volume,
stored heat, adiabatic heating, the flow through the top and bottom faces, and the
unweighted temperature statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.functions.columns import effective_bottom, open_face, total
from thermobox.operators.domain import Box
from thermobox.operators.weights import weight_column, with_cell_area
from thermobox.sources.state import GridState
from thermobox.specs import ANCHOR_K, CP_DRY, R_DRY, BoxSpec, SurfacePolicy


def domain_cells(
    state: GridState, box: Box, policy: SurfacePolicy, fields: Sequence[str] = ("T", "w")
) -> DataFrame:
    """Rows of the domain with `area` (m2), `air` (weighted volume, m2 Pa) and the level bounds."""
    inside = with_cell_area(box.domain(state), box)
    rows = inside.rows(fields, ["sp", "area"])
    return with_air(box.attach(rows, "level", "level_id", "p_start", "p_end", "dp"), box.spec, policy)


def with_air(cells: DataFrame, spec: BoxSpec, policy: SurfacePolicy) -> DataFrame:
    """Add the effective `bottom` and `air` to cells with sp, area and their level's bounds."""
    return cells.withColumn("bottom", effective_bottom(F.col("sp"), spec)).withColumn(
        "air", F.col("area") * F.col("dp") * weight_column(spec, policy)
    )


def volume_integral(cells: DataFrame, **integrands: Column) -> DataFrame:
    """Sum of each integrand x weighted cell volume, per time."""
    return cells.groupBy("time").agg(
        *[total(expression * F.col("air")).alias(name) for name, expression in integrands.items()]
    )


def area_integral(pieces: DataFrame, **integrands: Column) -> DataFrame:
    """Sum of each integrand x `area` x `weight`, per time, over pieces of one face."""
    return pieces.groupBy("time").agg(
        *[
            total(expression * F.col("area") * F.col("weight")).alias(name)
            for name, expression in integrands.items()
        ]
    )


def domain_volume(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """Volume above ground, also where T is missing."""
    return volume_integral(domain_cells(state, box, policy, ()), volume=F.lit(1.0))


def heating_rate() -> Column:
    """Adiabatic heating of a parcel, K/s."""
    return F.col("w") * F.lit(R_DRY) * F.col("T") / F.col("level") / F.lit(CP_DRY)


def require_level(level_values: Sequence[float], pressure: float | Column) -> None:
    """Of a pressure by row, whoever makes the rows has checked the values."""
    if not isinstance(pressure, Column) and float(pressure) not in level_values:
        raise ValueError(f"no level at {pressure} Pa: a face of the box must lie on a level")


def volume_moments(
    state: GridState, box: Box, policy: SurfacePolicy, faces: bool = True
) -> DataFrame:
    """One row per time with all domain sums.

    volume, heat, adiabatic; lift is the adiabatic sum for 1 K; cells, warmth and warmth2
    are count, sum and sum of squares of T - ANCHOR_K over all cells of the domain,
    unweighted. heat_/mass_/warm_ are the flows through the horizontal faces, from the
    unblended values on that level: heat relative to ANCHOR_K, warm the mass flow where T
    is known.
    """
    return moment_sums(domain_cells(state, box, policy), box.spec, box.level_values, faces)


def moment_sums(
    cells: DataFrame, spec: BoxSpec, level_values: Sequence[float], faces: bool = True, keys: Sequence[str] = ("time",)
) -> DataFrame:
    """The sums of `volume_moments` of cells with T, w, sp, level, area and air, per `keys`."""
    air, temperature = F.col("air"), F.col("T")
    warmth, lift = F.col("warmth"), F.col("lift")
    cells = cells.withColumns({
        "warmth": temperature - F.lit(ANCHOR_K),
        "lift": F.col("w") * F.lit(R_DRY) / F.col("level") / F.lit(CP_DRY) * air,
    })
    sums = [
        total(air).alias("volume"),
        total(temperature * air).alias("heat"),
        total(temperature * lift).alias("adiabatic"),
        total(lift).alias("lift"),
        F.count("warmth").alias("cells"),
        F.sum(warmth).alias("warmth"),
        F.sum(warmth * warmth).alias("warmth2"),
    ]
    levels = {"top": spec.top_pressure, "bottom": spec.bottom_pressure}
    for wall in spec.walls[4:] if faces else ():
        require_level(level_values, levels[wall])
        on_level = F.col("level") == F.lit(levels[wall])
        flow = F.col("w") * F.col("area") * open_face(F.col("sp"), levels[wall])
        cells = cells.withColumn(f"flow_{wall}", F.when(on_level, flow))
        flow = F.col(f"flow_{wall}")
        sums += [
            total(flow * warmth).alias(f"heat_{wall}"),
            total(flow).alias(f"mass_{wall}"),
            total(F.when(warmth.isNotNull(), flow)).alias(f"warm_{wall}"),
        ]
    return cells.groupBy(*keys).agg(*sums)
