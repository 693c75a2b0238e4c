import numpy as np
import pytest

from tests.grids import HPA, cells, frame, ground_box, make_state, null_where, pressure_box, wide_of
from thermobox.operators.domain import resolve_box
from thermobox.operators.weights import horizontal_weights, volume_weights, wall_weights
from thermobox.sources.state import GridState
from thermobox.specs import SurfacePolicy
from pyspark.sql import functions as F

CLIPPED = SurfacePolicy(allow_overflow=False)
OVERFLOW = SurfacePolicy(allow_overflow=True)

WALL_SP = np.array([
    [900, 910, 930, 940],
    [910, 920, 910, 920],
    [920, 930, 890, 900],
    [930, 940, 1200, 880],
]) * HPA
# By wall: rows are levels, columns positions of the domain.
WALL_WEIGHTS = {
    "east": [[0.15, 0.00], [0.20, 0.15]],
    "west": [[0.15, 0.25], [0.20, 0.20]],
    "south": [[0.15, 0.20], [0.20, 0.20]],
    "north": [[0.35, 1.45], [0.20, 0.20]],
}


def test_volume_weight_at_surface_and_top(spark):
    axis = [float(x) for x in range(6)]
    state = make_state(spark, level=[1e5, 9e4, 8e4, 7e4], lat=axis, lon=[x + 15 for x in axis])
    box = resolve_box(state, ground_box((0, 5, 15, 20), top=790 * HPA))
    got = cells(volume_weights(state, box, CLIPPED), "W_volume", "lat_id", "lon_id", "level_id")
    assert len(got) == 9 * 4
    for (_, _, level_id), weight in got.items():
        assert weight == pytest.approx([0.5, 1.0, 0.6, 0.0][level_id], abs=1e-12)


def test_horizontal_faces_are_binary(spark):
    sp = {(1, 1): 95000.0, (1, 2): 85000.0, (2, 1): 75000.0, (2, 2): 90500.0}
    state = make_state(spark, level=[95000.0, 85000.0, 75000.0], lat=[0.0, 1, 2, 3, 4], lon=[10.0, 11, 12, 13, 14],
                       sp=lambda t, i, j: sp.get((i, j), 1e5))
    box = resolve_box(state, pressure_box((0, 4, 10, 14), top=8e4, bottom=9e4))
    faces = horizontal_weights(state, box)
    top, bottom = (cells(faces, name, "lat_id", "lon_id") for name in ("W_top", "W_bottom"))
    assert top == {key: float(p > 8e4) for key, p in sp.items()}
    assert bottom == {key: float(p > 9e4) for key, p in sp.items()}


@pytest.mark.parametrize("policy", [OVERFLOW, CLIPPED])
@pytest.mark.parametrize("wide", [False, True])
def test_wall_weights_from_the_cells_astride(spark, policy, wide):
    state = make_state(spark, level=[95000.0, 85000.0], lat=[0.0, 1, 2, 3, 4], lon=[10.0, 11, 12, 13, 14],
                       sp=lambda t, i, j: float(WALL_SP[min(i, 3), min(j, 3)]))
    state = wide_of(state) if wide else state
    box = resolve_box(state, ground_box((0, 4, 10, 14), top=88000.0))
    got = cells(wall_weights(state, box, policy), "W_wall", "wall", "level_id", "along_id")
    assert len(got) == 4 * 2 * 2
    for wall, rows in WALL_WEIGHTS.items():
        for level_id, row in enumerate(rows):
            for position, weight in enumerate(row):
                want = weight if policy.allow_overflow else min(weight, 1.0)
                assert got[(wall, level_id, position + 1)] == pytest.approx(want, abs=1e-12)


def test_overflow_ignores_the_top_pressure(spark):
    """In the lowest layer overflow replaces the weight, even where the top lies below the ground."""
    axis = [0.0, 1.0, 2.0, 3.0]
    state = make_state(spark, level=[1e5, 9e4], lat=axis, lon=axis, sp=104000.0)
    box = resolve_box(state, ground_box((0, 3, 0, 3), top=100000.0))
    overflow = cells(volume_weights(state, box, OVERFLOW), "W_volume", "level_id")
    clipped = cells(volume_weights(state, box, CLIPPED), "W_volume", "level_id")
    assert overflow[(0,)] == pytest.approx(0.9) and clipped[(0,)] == pytest.approx(0.4)


def test_missing_ground_gives_missing_weights(spark):
    axis = [float(x) for x in range(5)]
    state = make_state(spark, level=[1e5, 9e4], lat=axis, lon=axis)
    hole = (F.col("lat") == 1) & (F.col("lon") == 1)
    state = GridState(state.upper, null_where(state.surface, hole, "sp"))
    box = resolve_box(state, pressure_box((0, 4, 0, 4), top=9e4, bottom=1e5))
    volume = cells(volume_weights(state, box, OVERFLOW), "W_volume", "lat_id", "lon_id", "level_id")
    assert {key for key, w in volume.items() if w is None} == {(1, 1, 0), (1, 1, 1)}
    face = {(r.lat_id, r.lon_id): (r.W_top, r.W_bottom) for r in horizontal_weights(state, box).collect()}
    assert face[(1, 1)] == (0.0, 0.0)
    walls = cells(wall_weights(state, box, OVERFLOW), "W_wall", "wall", "along_id", "level_id")
    assert {key[:2] for key, w in walls.items() if w is None} == {("west", 1), ("south", 1)}


def test_ground_on_a_layer_edge(spark):
    axis = [0.0, 1.0, 2.0, 3.0]
    state = make_state(spark, level=[1e5, 9e4, 8e4], lat=axis, lon=axis, sp=95000.0)
    box = resolve_box(state, ground_box((0, 3, 0, 3), top=8e4))
    assert cells(volume_weights(state, box, OVERFLOW), "W_volume", "level_id") == {(0,): 0.0, (1,): 1.0, (2,): 0.5}
    assert len(frame(horizontal_weights(state, box))) == 1
