import math
import random

import pytest
from pyspark.sql import functions as F

from tests.grids import cells, ground_box, make_state, pressure_box
from thermobox.operators.axes import Tiling, coordinate_axes, measure_axes, numbered, order_breaks, tile_starts
from thermobox.operators.domain import (
    cell_volumes,
    axis_points,
    halo_cells,
    horizontal_areas,
    resolve_box,
    wall_areas,
)
from thermobox.sources.state import GridState
from thermobox.specs import EARTH_RADIUS, BoxRequest, BoxSpec, SurfacePolicy

LEVELS = [100000.0, 90000.0, 80000.0, 70000.0, 60000.0, 50000.0]
TENS = dict(level=LEVELS, lat=[0.0, 10.0, 20.0, 30.0, 40.0], lon=[100.0, 110.0, 120.0, 130.0])


@pytest.fixture(scope="module")
def fine(spark):
    return make_state(spark, level=LEVELS, lat=[float(x) for x in range(7)], lon=[float(x) for x in range(10, 16)])


@pytest.fixture(scope="module")
def coarse(spark):
    state = make_state(spark, **TENS)
    return state, resolve_box(state, pressure_box((0, 40, 100, 130)))


def test_crop_to_cells(fine):
    box = resolve_box(fine, pressure_box((0, 6, 10, 15)))
    inner_lats = box.lats.where("lat_in").orderBy("lat_id").collect()
    inner_lons = box.lons.where("lon_in").orderBy("lon_id").collect()
    assert [r.lat_id for r in inner_lats] == [1, 2, 3, 4]
    assert [r.lon_id for r in inner_lons] == [1, 2, 3]
    assert [r.lat_mid for r in inner_lats] == [1.5, 2.5, 3.5, 4.5]
    assert [(r.lon_start, r.lon_end) for r in inner_lons] == [(11, 12), (12, 13), (13, 14)]
    assert box.spec == BoxSpec((1.0, 5.0), (11.0, 14.0), 50000.0, 100000.0)
    assert (box.lats.count(), box.lons.count()) == (6, 5)


def test_margin_too_large(fine):
    with pytest.raises(ValueError, match="too large"):
        resolve_box(fine, pressure_box((0, 6, 10, 15), margin=3))
    with pytest.raises(ValueError, match="too small"):
        resolve_box(fine, pressure_box((1, 3, 11, 13), margin=1))


@pytest.mark.parametrize("bbox", [(-1, 6, 10, 15), (0, 7, 10, 15), (0, 6, 9, 15), (0, 6, 10, 16)])
def test_box_outside_grid(fine, bbox):
    with pytest.raises(ValueError, match="outside the grid"):
        resolve_box(fine, pressure_box(bbox))


@pytest.mark.parametrize("top, bottom", [(40000, 90000), (50000, 110000), (90000, 80000), (80000, 80000)])
def test_bad_pressures(fine, top, bottom):
    with pytest.raises(ValueError, match="pressure"):
        resolve_box(fine, pressure_box((0, 6, 10, 15), top=top, bottom=bottom))


def test_bad_requests():
    with pytest.raises(ValueError, match="margin"):
        BoxRequest(margin=0)
    assert not SurfacePolicy().use_surface_fields and SurfacePolicy(surface_mode="combined").use_surface_fields


def test_box_to_the_ground_has_no_bottom_face(fine):
    spec = resolve_box(fine, BoxRequest(bbox=(0, 6, 10, 15), top_pressure=5e4)).spec
    assert spec.bottom_pressure is None and not spec.closed_below and "bottom" not in spec.walls


def test_long_axis(spark):
    """Only the halo of a long axis comes to the driver."""
    lats = spark.range(250_000).selectExpr("'lat' AS axis", "id * 0.0005D AS value")
    rest = spark.createDataFrame([("lon", float(x)) for x in range(6)] + [("level", 1e5), ("level", 9e4)], "axis string, value double")
    axes = lats.unionByName(rest)
    points = axis_points(axes, {"a": BoxRequest(bbox=(60.0, 60.005, 0.0, 5.0), margin=1)})["a"]
    assert points["lat"].n == 250_000 and len(points["lat"].values) == 11 and points["lat"].first == 120_000
    box = resolve_box(GridState(spark.range(0)), BoxRequest(bbox=(60.0, 60.005, 0.0, 5.0), margin=1, top_pressure=9e4), axes)
    assert box.lats.count() == 10 and box.spec.lat == pytest.approx((60.0005, 60.0045))


def test_box_edge_rules_match_index_search(fine, spark):
    """A cell is covered exactly when it lies between the last start <= low and the first start >= high."""
    starts = [float(x) for x in range(7)]
    rng = random.Random(3)
    axes = spark.createDataFrame([("lat", s) for s in starts] + [("lon", s) for s in starts] + [("level", 1.0), ("level", 2.0)],
                                 "axis string, value double")
    for _ in range(8):
        low, high = sorted(rng.choice([rng.uniform(0, 6), float(rng.randrange(7))]) for _ in range(2))
        covered = measure_axes(axes, ground_box((low, high, low, high))).where("axis = 'lat' AND covered")
        got = sorted(r.id for r in covered.collect())
        first = max(i for i, s in enumerate(starts) if s <= low)
        last = min(i for i, s in enumerate(starts) if s >= high)
        assert got == list(range(first, min(last, 6))), (low, high)


def test_uneven_level_edges(spark):
    axes = spark.createDataFrame([("level", p) for p in (1000.0, 900.0, 750.0)], "axis string, value double")
    rows = measure_axes(axes).orderBy("id").collect()
    assert [(r.lower_edge, r.upper_edge) for r in rows] == [(1050, 950), (950, 825), (825, 675)]


def test_horizontal_areas(coarse):
    state, box = coarse
    areas = cells(horizontal_areas(box), "area", "lat_id", "lon_id")
    d_lon = math.radians(120) - math.radians(110)
    for lat_id, (south, north) in {1: (10, 20), 2: (20, 30)}.items():
        want = EARTH_RADIUS**2 * abs(math.sin(math.radians(north)) - math.sin(math.radians(south))) * d_lon
        assert areas[(lat_id, 1)] == pytest.approx(want, rel=1e-12)
    assert len(areas) == 2


def test_wall_areas(coarse):
    _, box = coarse
    areas = cells(wall_areas(box), "area", "wall", "level_id", "along_id")
    assert len(areas) == 6 * (4 + 4 + 3 + 3)
    step = math.radians(10)
    for k in range(6):
        for i in range(4):
            assert areas[("west", k, i)] == areas[("east", k, i)] == pytest.approx(1e4 * EARTH_RADIUS * step, rel=1e-12)
        for j in range(3):
            assert areas[("south", k, j)] == pytest.approx(1e4 * EARTH_RADIUS * math.cos(0.0) * step, rel=1e-12)
            assert areas[("north", k, j)] == pytest.approx(1e4 * EARTH_RADIUS * math.cos(math.radians(40)) * step, rel=1e-12)


def test_volume_is_area_times_depth(coarse):
    _, box = coarse
    volume = sum(cells(cell_volumes(box), "volume", "level_id", "lat_id", "lon_id").values())
    area = sum(cells(horizontal_areas(box), "area", "lat_id", "lon_id").values())
    assert volume == pytest.approx(area * 60000.0, rel=1e-10)


def test_halo_core_is_domain(coarse):
    _, box = coarse
    rows = halo_cells(box).collect()
    lats, lons = sorted({r.lat_id for r in rows}), sorted({r.lon_id for r in rows})
    inside = {(r.lat_id, r.lon_id) for r in rows if r.in_domain}
    assert inside == {(i, j) for i in lats[1:-1] for j in lons[1:-1]}


def test_close_coordinates_are_refused(spark):
    state = make_state(spark, level=[1e5, 9e4], lat=[0.0, 1.0, 2.0, 2.0000001, 3.0], lon=[0.0, 1.0, 2.0, 3.0])
    with pytest.raises(ValueError, match="millionth"):
        resolve_box(state, ground_box((0, 3, 0, 3), top=9e4))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_sees_a_whole_axis(spark, fine):
    """Windows are by block; a request is resolved by one aggregate."""
    axes = coordinate_axes(fine.upper)
    plan = plan_of(measure_axes(axes, pressure_box((0, 6, 10, 15))))
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("[_block#" in line and "[axis#" not in line for line in windows), plan
    assert "Window" not in plan_of(fine.upper.where(resolve_box(fine, pressure_box((0, 6, 10, 15))).halo_filter()))


@pytest.mark.parametrize("block", [2, 3, 8192])
def test_numbers_and_neighbours_across_blocks(spark, monkeypatch, block):
    from thermobox.operators import series

    monkeypatch.setattr(series.index_by, "__defaults__", ("time", (), block))
    values = {"lat": [float(x * x) for x in range(11)], "lon": [5.0], "level": [9e4, 8e4, 7e4]}
    axes = spark.createDataFrame([(a, v) for a, vs in values.items() for v in vs], "axis string, value double")
    found = {(r["axis"], r["value"]): (r["id"], r["before"], r["after"]) for r in numbered(axes.withColumn("o", F.col("value")), "o").collect()}
    for axis, vs in values.items():
        vs = sorted(vs)
        assert [found[axis, v] for v in vs] == [(i, vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None) for i in range(len(vs))]


def test_source_order_is_checked_across_blocks(spark, monkeypatch):
    from thermobox.operators import series

    monkeypatch.setattr(series.index_by, "__defaults__", ("time", (), 3))
    rng = random.Random(1)
    points, want = [], {"level": 0, "lat": 0, "lon": 0}
    for axis in want:
        values = [rng.uniform(0, 100) for _ in range(20)]
        points += [(axis, v, i * 7) for i, v in enumerate(values)]
        want[axis] = sum((b >= a) if axis == "level" else (b <= a) for a, b in zip(values, values[1:]))
    found = order_breaks(spark.createDataFrame(points, "axis string, value double, seen long"), "seen")
    assert {r["axis"]: r["n_bad"] for r in found.collect()} == want


def test_tiles(spark):
    axes = spark.createDataFrame([("lat", i * 0.25) for i in range(100)] + [("lon", float(i)) for i in range(5)], "axis string, value double")
    rows = tile_starts(axes, 36, 256).collect()
    assert sorted((r["axis"], r["tile"], r["start"]) for r in rows) == [("lat", 0, 0.0), ("lat", 1, 9.0), ("lat", 2, 18.0), ("lon", 0, 0.0)]
    assert tile_starts(axes, 2, 4).where("axis = 'lat'").count() == 4
    tiling = Tiling((0.0, 9.0, 18.0), (0.0,))
    values = [-3.0, 0.0, 8.99, 9.0, 17.75, 18.0, 99.0]
    found = spark.createDataFrame([(v, v) for v in values], "lat double, lon double").select(tiling.column("lat"), tiling.column("lon")).collect()
    assert [tuple(r) for r in found] == [(tiling.number("lat", v), 0) for v in values] == [(n, 0) for n in (0, 0, 0, 1, 1, 2, 2)]
