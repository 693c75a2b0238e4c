"""Flow through the four side walls.

Only the cells astride a wall are read: the ring filter is literal and reaches the
scan. Blending with the near-surface fields happens on those rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermobox.functions.columns import (
    blend_with_surface,
    effective_bottom,
    ground_case,
    touches_ground,
)
from thermobox.operators.domain import Box, cell_key, wall_pieces
from thermobox.operators.weights import pair_mean, weight_column
from thermobox.sources.state import GridState
from thermobox.specs import ANCHOR_K, SIDE_WALLS, WALL_SIGN, BoxSpec, SurfacePolicy

LAYER = ("level_id", "p_start", "p_end", "p_mid")
NEAR_SURFACE_OF = {"T": "T2m", "u": "u10", "v": "v10"}


def case_column(policy: SurfacePolicy) -> Column:
    return ground_case(
        F.col("level_id"), F.col("p_start"), F.col("p_end"), F.col("p_mid"), F.col("sp"), policy
    )


def surface_cases(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """Each halo layer with its case: 'A' untouched, 'B' or 'C' cut by the ground."""
    rows = box.crop(state).rows([], ["sp"])
    return box.attach(rows, "level", *LAYER).withColumn("case", case_column(policy))


def blend_near_surface(rows: DataFrame, box: Box, policy: SurfacePolicy) -> DataFrame:
    """Replace T, u, v of the layer cut by the ground by the blended value.

    In case C the new value of a layer is made from the layer above it and the surface, not
    from its own. So the row above, which knows sp and the bounds of the layer below, hands
    it out, and the own row is left out. Each level keeps one row per column, and no row has
    to see another: a projection without window, sort or shuffle. At the top level, where
    nothing lies above, the surface value stands in.

    `rows` carry sp and the near-surface fields; `level` gives way to `level_id`.
    """
    layer = box.attach(rows, "level", *LAYER, "below_start", "below_end", "below_mid", "is_top")
    sp, level_id = F.col("sp"), F.col("level_id")
    below_case = ground_case(
        level_id - 1, F.col("below_start"), F.col("below_end"), F.col("below_mid"), sp, policy
    )
    layer = layer.withColumns({"case": case_column(policy), "below_case": below_case})
    # Levels this row speaks for, relative to its own.
    shifts = F.expr(
        "CASE WHEN below_case = 'C' THEN array(0, -1) WHEN case = 'C' AND NOT is_top THEN slice(array(0), 1, 0)"
        " ELSE array(0) END"
    )
    spoken = layer.withColumn("shift", F.explode(shifts))
    from_above = F.when(F.col("shift") == -1, "C").otherwise(F.col("case"))
    above_is_own = F.col("shift") == -1
    blended = {
        name: blend_with_surface(
            from_above, F.col(name), F.when(above_is_own, F.col(name)), F.col(near), F.col("p_end"), F.col("p_mid"), sp
        ).alias(name)
        for name, near in NEAR_SURFACE_OF.items()
    }
    kept = [n for n in rows.columns if n not in ("level", *NEAR_SURFACE_OF, *NEAR_SURFACE_OF.values())]
    return spoken.select(*kept, (level_id + F.col("shift")).alias("level_id"), *blended.values())


def blended_state(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """T, u, v of all halo cells as they enter the wall values."""
    rows = box.crop(state).rows(("T", "u", "v"), ("sp", *NEAR_SURFACE_OF.values()))
    return blend_near_surface(rows, box, policy)


def surface_shares(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """Share of columns with a layer cut by the ground, in percent: of all, and of the open ones.

    Also the largest number of cut layers in one column, which must be at most 1. The
    layers enter as a literal array, so a column is one row and nothing is joined.
    """
    ground = box.crop(state).ground(["sp"], box.lowest_level)
    sp = F.col("sp")
    cut = sum(
        touches_ground(F.lit(i), F.lit(start), F.lit(end), sp, policy).cast("int")
        for i, (start, end, _) in enumerate(box.layers)
    )
    touched = (F.col("cut") > 0).cast("double")
    is_open = sp > F.lit(box.spec.top_pressure)
    return ground.withColumn("cut", cut).agg(
        (F.avg(touched) * 100).alias("pct_columns"),
        (F.avg(F.when(is_open, touched)) * 100).alias("pct_active"),
        F.max("cut").alias("max_layers"),
    )


def wall_faces(state: GridState, box: Box, policy: SurfacePolicy) -> DataFrame:
    """Values at each wall piece: flow and T are means of the two cells astride the wall.

    Columns time, wall, level_id, along_id, flow (u through west and east, v through south
    and north), T, weight, area. The means group by three integers; names and geometry are
    attached to the result, half as many rows.
    """
    return piece_faces(box.ring(state), box, wall_pieces(box), box.spec, policy)


def piece_faces(
    state: GridState, box: Box, pieces: DataFrame, spec: BoxSpec, policy: SurfacePolicy, carried: Sequence[str] = ()
) -> DataFrame:
    """`wall_faces` of the given pieces; `carried` columns of `pieces` are kept, and `spec` may be made of them."""
    surface_fields = ("sp", *NEAR_SURFACE_OF.values()) if policy.use_surface_fields else ("sp",)
    rows = state.rows(("T", "u", "v"), surface_fields)
    if policy.use_surface_fields:
        rows = blend_near_surface(rows, box, policy)
    else:
        rows = box.attach(rows, "level", "level_id")
    named = pieces.select("piece", "wall", "along_id", "span", *carried)
    zonal_wind = pieces.select("piece", F.explode("cells").alias("cell_key"), F.expr("wall IN ('west', 'east')").alias("zonal"), *carried)
    means = (
        rows.select("time", "level_id", cell_key().alias("cell_key"), "T", "u", "v", "sp")
        .join(F.broadcast(zonal_wind), "cell_key")
        .select("time", "level_id", "piece", "T", effective_bottom(F.col("sp"), spec).alias("bottom"), F.expr("if(zonal, u, v) AS flow"))
        .groupBy("time", "level_id", "piece")
        .agg(pair_mean("flow"), pair_mean("T"), pair_mean("bottom"))
    )
    return (
        means.join(F.broadcast(box.levels), "level_id")
        .join(F.broadcast(named), "piece")
        .select("time", "wall", "level_id", "along_id", "flow", "T", *carried,
                weight_column(spec, policy).alias("weight"), (F.col("span") * F.col("dp")).alias("area"))
    )


def wall_sums(faces: DataFrame, reference: Column | None = None, keys: Sequence[str] = ("time",)) -> DataFrame:
    """heat_, mass_ and warm_ of each side wall per time, or per `keys`.

    Heat is relative to `reference` (default ANCHOR_K); warm is the mass flow where T is
    known. Because the wall value is linear in T, heat relative to any other temperature
    c is heat - (c - reference) * warm.
    """
    if reference is None:
        reference = F.lit(ANCHOR_K)
    pieces = faces.select(
        *keys, "wall",
        (F.col("flow") * F.col("area") * F.col("weight")).alias("mass"),
        (F.col("T") - reference).alias("warmth"),
    ).selectExpr(*keys, "wall", "mass", "mass * warmth AS heat", "if(warmth IS NOT NULL, mass, NULL) AS warm")
    return pieces.groupBy(*keys).agg(*[
        F.expr(f"coalesce(sum({kind}) FILTER (WHERE wall = '{wall}'), 0.0D) AS {kind}_{wall}")
        for wall in SIDE_WALLS for kind in ("heat", "mass", "warm")
    ])


def advection_columns(spec: BoxSpec, shift: Column | None) -> list[Column]:
    """Signed wall contributions and their sums from heat_, mass_ and warm_ columns.

    `shift` is the temperature to subtract, relative to that of the heat columns.
    """
    heat, mass = {}, {}
    for wall in spec.walls:
        raw = F.col(f"heat_{wall}")
        if shift is not None:
            raw = F.coalesce(raw - shift * F.col(f"warm_{wall}"), F.lit(0.0))
        heat[wall] = F.lit(WALL_SIGN[wall]) * raw
        mass[wall] = F.lit(WALL_SIGN[wall]) * F.col(f"mass_{wall}")
    net_mass = sum(mass.values())
    gross = sum(F.abs(flow) for flow in mass.values())
    return [
        sum(heat.values()).alias("net_heat_advection"),
        net_mass.alias("net_mass_advection"),
        F.try_divide(F.abs(net_mass), gross).alias("abs_mass_advection_residual_fraction"),
        *[flow.alias(f"flux_contribution_{wall}") for wall, flow in heat.items()],
        *[flow.alias(f"mass_flux_contribution_{wall}") for wall, flow in mass.items()],
    ]
