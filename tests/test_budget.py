import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.grids import cells, frame, ground_box, hours, make_state, null_where, pressure_box, wide_of
from thermobox.operators.domain import horizontal_areas, resolve_box, wall_areas
from thermobox.operators.volume import domain_cells, volume_moments
from thermobox.operators.walls import (
    advection_columns,
    blended_state,
    surface_cases,
    surface_shares,
    wall_faces,
    wall_sums,
)
from thermobox.operators.weights import horizontal_weights, wall_weights
from thermobox.plans import diagnostics
from thermobox.plans.budget import BUDGET_FIELDS, BudgetRun, hourly_moments, run_budget
from thermobox.sources.state import GridState
from thermobox.specs import ANCHOR_K, BoxRequest, SurfacePolicy

LEVELS = [100000.0, 90000.0, 80000.0, 70000.0, 60000.0, 50000.0]
GRID = dict(level=LEVELS, lat=[0, 10, 20, 30, 40, 50], lon=[90, 100, 110, 120, 130, 140], times=hours(2))
CLIPPED = SurfacePolicy(allow_overflow=False)
OVERFLOW = SurfacePolicy()
BLENDED = SurfacePolicy(surface_mode="combined")
CLOSED = pressure_box((10, 40, 100, 130))
GROUND = ground_box((10, 40, 100, 130))


def advection(state, request, policy=CLIPPED):
    """Advection of T itself, not of its anomaly."""
    box = resolve_box(state, request)
    moments = hourly_moments(state, box, policy)
    return frame(moments.select("time", *advection_columns(box.spec, F.lit(-ANCHOR_K))), "time"), box


def test_no_flow_gives_nothing(spark):
    out, _ = advection(make_state(spark, **GRID, sp=101500.0), CLOSED)
    assert (out.net_mass_advection == 0).all() and (out.net_heat_advection.abs() < 1e-12).all()
    assert out.abs_mass_advection_residual_fraction.isna().all()


def test_zonal_flow_closes(spark):
    """West and east hold the same pieces; Spark adds them in no fixed order, so zero is up to
    the last bit of the gross flow."""
    out, _ = advection(make_state(spark, **GRID, sp=101500.0, u=7.5), CLOSED)
    gross = 2 * out.mass_flux_contribution_east.abs().min()
    assert gross > 1e11
    np.testing.assert_allclose(out.net_mass_advection / gross, 0.0, atol=1e-15)
    np.testing.assert_allclose(out.net_heat_advection / (300 * gross), 0.0, atol=1e-15)


def test_meridional_flow_leaves_the_wall_difference(spark):
    out, _ = advection(make_state(spark, **GRID, sp=101500.0, v=7.5), CLOSED)
    np.testing.assert_allclose(out.net_mass_advection, -91220138235.36966, rtol=1e-12)
    np.testing.assert_allclose(out.net_heat_advection, -27366041470610.9, rtol=1e-10)


def test_compensating_vertical_flow_closes(spark):
    quiet = make_state(spark, **GRID, sp=100000.0)
    box = resolve_box(quiet, GROUND)
    areas = cells(wall_areas(box), "area", "wall", "level_id", "along_id")
    weights = cells(wall_weights(quiet, box, CLIPPED).where("time = '2000-01-01 00:00:00'"), "W_wall", "wall", "level_id", "along_id")
    through = {w: sum(areas[k] * weights[k] for k in weights if k[0] == w) for w in ("north", "south")}
    top = sum(r.W_top * cells(horizontal_areas(box), "area", "lat_id", "lon_id")[(r.lat_id, r.lon_id)]
              for r in horizontal_weights(quiet, box).where("time = '2000-01-01 00:00:00'").collect())
    w = 7.5 * (through["north"] - through["south"]) / top
    assert w == pytest.approx(-0.08150728607567591, rel=1e-12)
    out, _ = advection(make_state(spark, **GRID, sp=100000.0, u=10.0, v=7.5, w=w), GROUND)
    np.testing.assert_allclose(out.net_mass_advection, 0.0, atol=1e-4)
    np.testing.assert_allclose(out.net_heat_advection, 0.0, atol=3e-2)


def wavy(spark, n=6, hole=False):
    rng = np.random.default_rng(5)
    shape = (n, 4, 6, 6)
    fields = {name: rng.normal(size=shape) * s for name, s in (("T", 10.0), ("u", 8.0), ("v", 8.0), ("w", 0.2))}
    sp = rng.uniform(84000, 107000, size=(n, 6, 6))
    state = make_state(
        spark, level=LEVELS[:4], lat=[40, 45, 50, 55, 60, 65], lon=[-130, -125, -120, -115, -110, -105], times=hours(n),
        T=lambda *i: float(280 + fields["T"][i]), u=lambda *i: float(fields["u"][i]),
        v=lambda *i: float(fields["v"][i]), w=lambda *i: float(fields["w"][i]), sp=lambda *i: float(sp[i]))
    if hole:
        place = (F.col("lat") == 45) & (F.col("lon") == -125)
        upper = null_where(state.upper, place & (F.col("level") == 90000), "T")
        upper = null_where(upper, (F.col("lat") == 50) & (F.col("lon") == -130), "u")
        state = GridState(upper, null_where(state.surface, (F.col("lat") == 55) & (F.col("lon") == -115), "sp"))
    return state


BOX = BoxRequest(bbox=(40, 65, -130, -105))
LEVEL_BOX = BoxRequest(bbox=(40, 65, -130, -105), bottom_pressure=90000.0)
VARIANTS = [(BOX, OVERFLOW), (BOX, CLIPPED), (LEVEL_BOX, OVERFLOW), (BOX, BLENDED), (LEVEL_BOX, BLENDED)]


@pytest.mark.parametrize("request_, policy", VARIANTS)
def test_wide_and_split_states_agree(spark, request_, policy):
    state = wavy(spark, hole=True)
    one, two = (frame(run_budget(s, request_, policy).table(), "time") for s in (state, wide_of(state)))
    assert list(one.columns) == ["time", *BUDGET_FIELDS]
    for name in BUDGET_FIELDS:
        np.testing.assert_allclose(one[name], two[name], rtol=1e-9, err_msg=name)


@pytest.mark.parametrize("request_, policy", VARIANTS)
def test_shifted_sums_equal_a_second_pass(spark, request_, policy):
    """heat - (c - anchor) * warm is the heat of T - c, also where T or u is missing."""
    state = wavy(spark, hole=True)
    run = run_budget(state, request_, policy)
    box = run.box
    means = run.moments.frame.selectExpr("time", "heat / volume AS mean_t")
    faces = wall_faces(state, box, policy).join(means, "time")
    second = frame(wall_sums(faces, F.col("mean_t")), "time").iloc[1:-1].reset_index(drop=True)
    first = frame(run.advection(), "time")
    for wall, sign in (("west", -1), ("east", 1), ("south", -1), ("north", 1)):
        np.testing.assert_allclose(first[f"flux_contribution_{wall}"], sign * second[f"heat_{wall}"], rtol=1e-9)
        np.testing.assert_allclose(first[f"mass_flux_contribution_{wall}"], sign * second[f"mass_{wall}"], rtol=1e-12)
    walls = [c for c in first.columns if c.startswith("flux_contribution")]
    np.testing.assert_allclose(first[walls].sum(axis=1), first.net_heat_advection, rtol=1e-9)
    assert len(walls) == (6 if box.spec.closed_below else 5)


@pytest.mark.parametrize("request_, policy", VARIANTS)
def test_constant_temperature_equals_a_real_rerun(spark, request_, policy):
    state = wavy(spark, hole=True)
    run = run_budget(state, request_, policy)
    quick = frame(run.constant_temperature().table(), "time")
    scale = run.table().first().T_scale
    constant = GridState(state.upper.withColumn("T", F.lit(scale)), state.surface.withColumn("T2m", F.lit(scale)))
    rerun = frame(run_budget(constant, run.box, policy, anomalies=False).table(), "time")
    size = float(rerun.advection_term.abs().max())
    for name in BUDGET_FIELDS:
        np.testing.assert_allclose(quick[name], rerun[name], rtol=1e-8, atol=1e-9 * size, err_msg=name)


def test_budget_closes(spark):
    out = frame(run_budget(wavy(spark), BOX).table(), "time")
    rebuilt = -out.advection_term + out.adiabatic_term + out.diabatic_term
    np.testing.assert_allclose(rebuilt, out.dT_dt, rtol=1e-10)
    assert len(out) == 4


def test_scale_is_the_unweighted_spread(spark):
    state = wavy(spark, hole=True)
    run = run_budget(state, BOX)
    means = run.moments.frame.selectExpr("time", "heat / volume AS mean_t")
    inside = domain_cells(state, run.box, OVERFLOW).join(means, "time")
    want = inside.selectExpr("sqrt(avg((T - mean_t) * (T - mean_t)))").first()[0]
    assert run.table().first().T_scale == pytest.approx(want, rel=1e-12)


def test_volume_counts_cells_without_temperature(spark):
    state = wavy(spark)
    blank = GridState(state.upper.withColumn("T", F.lit(None).cast("double")), state.surface)
    box = resolve_box(state, BOX)
    one, two = (frame(volume_moments(s, box, OVERFLOW), "time") for s in (state, blank))
    np.testing.assert_allclose(one.volume, two.volume, rtol=1e-12)
    assert (two.heat == 0).all() and (two.cells == 0).all()


def test_two_hours_have_no_interior(spark):
    run = run_budget(wavy(spark, n=2), BOX)
    assert run.table().count() == 0


def test_top_off_the_levels_is_refused(spark):
    state = wavy(spark)
    box = resolve_box(state, BoxRequest(bbox=BOX.bbox, top_pressure=72000.0))
    with pytest.raises(ValueError, match="no level"):
        volume_moments(state, box, OVERFLOW)
    assert volume_moments(state, box, OVERFLOW, faces=False).count() == 6


def blend_by_hand(column, near, sp, overflow):
    """Blend one column of (level, value) from the ground up."""
    out = []
    for k, (level, value) in enumerate(column):
        start, end = level + 5000, level - 5000
        touched = end < sp < start or (overflow and k == 0 and sp >= start)
        if not touched:
            out.append(value)
        elif sp > level:
            upper, lower = level - end, sp - level
            out.append((upper * value + lower * 0.5 * (value + near)) / (upper + lower))
        else:
            above = column[k + 1][1] if k + 1 < len(column) else None
            out.append(0.5 * ((near if above is None else above) + near))
    return out


@pytest.mark.parametrize("overflow", [True, False])
@pytest.mark.parametrize("sp", [84000.0, 90000.0, 92000.0, 95000.0, 100000.0, 104000.0, 105000.0, 107000.0, 66000.0, 69000.0, 74000.0])
def test_blend_cases(spark, sp, overflow):
    policy = SurfacePolicy(allow_overflow=overflow, surface_mode="combined")
    axis = [0.0, 1.0, 2.0, 3.0]
    state = make_state(spark, level=LEVELS[:4], lat=axis, lon=axis, sp=sp, T=lambda t, k, i, j: 300.0 - 8 * k)
    box = resolve_box(state, ground_box((0, 3, 0, 3), top=70000.0))
    got = cells(blended_state(state, box, policy).where("lat = 1 AND lon = 1"), "T", "level_id")
    want = blend_by_hand([(p, 300.0 - 8 * k) for k, p in enumerate(LEVELS[:4])], 286.0, sp, overflow)
    assert [got[(k,)] for k in range(4)] == pytest.approx(want, rel=1e-14)
    assert len(got) == 4
    share = surface_shares(state, box, policy).first()
    touched = surface_cases(state, box, policy).where("case <> 'A'").count()
    assert share.max_layers == (1 if touched else 0)
    assert share.pct_columns == (100.0 if touched else 0.0)
    assert share.pct_active == (None if sp <= 70000 else share.pct_columns)


@pytest.mark.parametrize("n", [3, 4, 5])
def test_running_integrals_of_short_runs(spark, n):
    """The time step is that of the whole run, so the integral of one interior hour is rate times step."""
    state = make_state(spark, **{**GRID, "times": hours(n)}, u=lambda t, k, i, j: 1.0 + t * t, sp=lambda t, i, j: 100000.0 + 90.0 * t * t)
    run = run_budget(state, GROUND, OVERFLOW)
    rates = [r.delta_mass for r in diagnostics.mass_series(run).orderBy("time").collect()]
    sums = [r.cumulative_delta_mass for r in diagnostics.mass_cumulative(run).orderBy("time").collect()]
    assert len(sums) == n - 2 and all(rates) and sums == pytest.approx(np.cumsum(rates))


@pytest.mark.parametrize("policy", [OVERFLOW, BLENDED])
def test_missing_points_count_as_missing_values(spark, policy):
    """A state without some points, columns and hours of the box, filled, gives what the same points with NULL give."""
    from thermobox.sources.state import fill_holes

    rng = np.random.default_rng(8)
    normal = lambda *a: float(rng.normal())
    whole = make_state(spark, level=LEVELS, lat=range(0, 60, 10), lon=range(90, 150, 10), times=hours(8), T=lambda *a: 280 + normal(),
                       u=normal, v=normal, w=normal, sp=lambda *a: float(85000 + 20000 * rng.random()))
    upper, surface = whole.upper.cache(), whole.surface.cache()
    point = "hash(time, level, lat, lon) % 7 = 0 OR hour(time) = 3"
    near = "hour(time) = 5 AND lat BETWEEN 0 AND 40 AND lon BETWEEN 90 AND 130"
    sparse = GridState(upper.where(f"NOT ({point})").where(f"NOT ({near})"), surface.where(f"NOT ({near})"))
    nulls = GridState(null_where(upper, F.expr(f"({point}) OR ({near})"), "T", "u", "v", "w"), null_where(surface, F.expr(near), "sp", "T2m", "u10", "v10"))
    fields = ("sp", "T2m", "u10", "v10")
    got = frame(run_budget(fill_holes(sparse, fields), GROUND, policy).table(), "time")
    want = frame(run_budget(nulls, GROUND, policy).table(), "time")
    assert list(got["time"]) == list(want["time"]) and len(got) == 6
    for field in BUDGET_FIELDS:
        np.testing.assert_allclose(got[field], want[field], rtol=1e-9, atol=1e-9 * want[field].abs().max(), err_msg=field)
