"""Budgets of many boxes in one run, and budgets that grow by days."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.grids import frame, ground_box, hours, make_state, pressure_box, wide_of
from thermobox.plans import diagnostics
from thermobox.plans.budget import BUDGET_FIELDS, run_budget
from thermobox.plans.incremental import read_run, write_moments
from thermobox.plans.many import run_budgets
from thermobox.sources.layout import read_state, write_state
from thermobox.sources.state import GridState
from thermobox.specs import BoxRequest, SurfacePolicy

LEVELS = [100000.0, 90000.0, 80000.0, 70000.0, 60000.0]
BLENDED = SurfacePolicy(surface_mode="combined")
OVERFLOW = SurfacePolicy()


def noisy(spark, times):
    rng = np.random.default_rng(5)
    normal = lambda *a: float(rng.normal())
    return make_state(
        spark, level=LEVELS, lat=range(0, 40, 5), lon=range(100, 135, 5), times=times, T=lambda *a: float(250 + 50 * rng.random()),
        u=normal, v=normal, w=lambda *a: 0.1 * normal(), sp=lambda *a: float(85000 + 20000 * rng.random()))


@pytest.fixture(scope="module")
def state(spark):
    return noisy(spark, hours(6))


def same(table, runs):
    """`table` (run, time, fields) holds the table of each run."""
    got = frame(table, "time")
    assert set(got["run"]) == set(runs)
    for name, run in runs.items():
        want = frame(run.table(), "time").sort_values("time").reset_index(drop=True)
        own = got[got["run"] == name].sort_values("time").reset_index(drop=True)
        assert list(own["time"]) == list(want["time"])
        for field in BUDGET_FIELDS:
            scale = want[field].abs().max()
            np.testing.assert_allclose(own[field], want[field], rtol=1e-9, atol=1e-9 * scale if scale else 0, err_msg=f"{name} {field}")


def requests(rng, n):
    out = {}
    for i in range(n):
        south, west = rng.choice([0, 5, 10]), rng.choice([100, 105, 110])
        bbox = (south, south + rng.choice([15, 20, 25]), west, west + rng.choice([15, 20]))
        out[f"box {i}"] = pressure_box(bbox, top=7e4, bottom=9e4) if i % 3 == 2 else ground_box(bbox, top=rng.choice([6e4, 7e4, 8e4]))
    return out


@pytest.mark.parametrize("policy, wide", [(OVERFLOW, False), (SurfacePolicy(allow_overflow=False), True), (BLENDED, False)])
def test_many_boxes_equal_each_alone(spark, state, policy, wide):
    own = wide_of(state) if wide else state
    wanted = requests(random.Random(3 + wide), 4)
    same(run_budgets(own, wanted, policy), {name: run_budget(own, request, policy) for name, request in wanted.items()})


def test_many_boxes_of_a_tiled_state(spark, state, tmp_path):
    write_state(state, f"{tmp_path}/s", tile_points=2)
    stored = read_state(spark, f"{tmp_path}/s")
    wanted = requests(random.Random(11), 3)
    same(run_budgets(stored, wanted), {name: run_budget(state, request) for name, request in wanted.items()})


def counted(spark, state):
    """A wide state that counts the rows read from it."""
    rows, wide = spark.sparkContext.accumulator(0), wide_of(state).upper

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return GridState(wide.mapInArrow(seen, wide.schema), axes=None), rows


def test_boxes_share_their_scans(spark, state):
    """As many rows are read for six boxes as for one: one pass for the axes, two for the sums."""
    read = []
    for n in (1, 6):
        own, rows = counted(spark, state)
        same_bottom = {f"{i}": ground_box((0, 35, 100, 130), top=7e4) for i in range(n)}
        assert run_budgets(own, same_bottom).count() == 4 * n
        read.append(rows.value)
    assert read[0] == read[1]


def test_hours_of_one_box_do_not_reach_into_another(spark, state):
    """A box whose ground is unknown at an hour still has its own neighbours in time only."""
    table = frame(run_budgets(state, {"a": ground_box((0, 20, 100, 120), top=7e4), "b": ground_box((5, 30, 105, 130), top=7e4)}), "time")
    assert table.groupby("run")["time"].agg(["min", "max", "count"]).values.tolist() == [
        [pd.Timestamp("2000-01-01 01:00"), pd.Timestamp("2000-01-01 04:00"), 4]] * 2


def test_wrong_requests(state):
    with pytest.raises(ValueError, match="no box"):
        run_budgets(state, {})
    with pytest.raises(ValueError, match="level"):
        run_budgets(state, {"a": ground_box((0, 20, 100, 120), top=75000.0)})
    with pytest.raises(ValueError, match="outside"):
        run_budgets(state, {"a": ground_box((0, 20, 100, 120), top=7e4), "b": ground_box((-5, 20, 100, 120), top=7e4)})


BOX = ground_box((0, 30, 100, 130), top=7e4)


@pytest.fixture(scope="module")
def two_days(spark):
    return noisy(spark, hours(48)[::4])


def days(state, *wanted):
    return state.restrict(F.dayofmonth("time").isin(*wanted))


@pytest.mark.parametrize("policy", [OVERFLOW, BLENDED])
def test_days_added_equal_one_run(spark, two_days, tmp_path, policy):
    write_moments(days(two_days, 1), BOX, policy, f"{tmp_path}/m")
    write_moments(days(two_days, 2), BOX, policy, f"{tmp_path}/m", append=True)
    write_moments(days(two_days, 2), BOX, policy, f"{tmp_path}/m", append=True)  # again: its hours are replaced
    run, whole = read_run(spark, f"{tmp_path}/m"), run_budget(two_days, BOX, policy)
    same(run.table().withColumn("run", F.lit("a")), {"a": whole})
    same(run.constant_temperature().table().withColumn("run", F.lit("a")), {"a": whole.constant_temperature()})
    assert diagnostics.heat_walls(run).count() == whole.table().count() > 4


def test_a_new_day_reads_that_day_only(spark, two_days, tmp_path):
    write_moments(days(two_days, 1), BOX, OVERFLOW, f"{tmp_path}/m")
    new = days(two_days, 2)
    own, rows = counted(spark, new)
    box = run_budget(new, BOX).box
    write_moments(own, box, OVERFLOW, f"{tmp_path}/m", append=True)
    assert rows.value == 2 * wide_of(new).upper.count()
    before = rows.value
    assert read_run(spark, f"{tmp_path}/m").table().count() > 4 and rows.value == before


def test_other_hours_are_refused(spark, two_days, tmp_path):
    write_moments(days(two_days, 1), BOX, OVERFLOW, f"{tmp_path}/m")
    for request, policy in ((ground_box((0, 30, 100, 125), top=7e4), OVERFLOW), (BOX, BLENDED)):
        with pytest.raises(ValueError, match="stored hours are of"):
            write_moments(days(two_days, 2), request, policy, f"{tmp_path}/m", append=True)
    with pytest.raises(ValueError, match="no hours"):
        read_run(spark, f"{tmp_path}/nothing")
    write_moments(days(two_days, 2), BoxRequest((0, 30, 100, 125), top_pressure=7e4), OVERFLOW, f"{tmp_path}/m")  # without append: anew
    assert read_run(spark, f"{tmp_path}/m").spec.lon == (105.0, 120.0)


def test_hours_of_many_days_are_few_files(spark, tmp_path):
    """Stored by year; days of one year are replaced without touching the others of that year, with or without a time."""
    import datetime as dt

    from thermobox.sources.layout import read_hours, write_hours

    schema = "time timestamp_ntz, value double"
    times = [dt.datetime(1999, 12, 1) + dt.timedelta(hours=6 * i) for i in range(240)]

    def hourly(chosen, value):
        return spark.createDataFrame([(t, value) for t in chosen], schema).repartition(8)

    write_hours(hourly([*times, None], 1.0), f"{tmp_path}/h", append=True)  # nothing is stored yet
    assert len(spark.read.parquet(f"{tmp_path}/h").inputFiles()) == 3
    again = [t for t in times if t.date() in (dt.date(1999, 12, 31), dt.date(2000, 1, 2))][1:]  # one hour is no longer given
    write_hours(hourly([*again, None], 2.0), f"{tmp_path}/h", append=True)
    write_hours(hourly([], 3.0), f"{tmp_path}/h", append=True)
    found = read_hours(spark, f"{tmp_path}/h", hourly([], 0.0).schema)
    assert len(found.inputFiles()) == 3
    expected = [(t, 2.0 if t in again or t is None else 1.0) for t in [*times, None] if t != again[0] - dt.timedelta(hours=6)]
    assert sorted(((r.time, r.value) for r in found.collect()), key=str) == sorted(expected, key=str)
    write_hours(hourly(again, 4.0), f"{tmp_path}/h")
    assert read_hours(spark, f"{tmp_path}/h", hourly([], 0.0).schema).count() == len(again)


def test_moments_of_many_days_are_few_files(spark, tmp_path):
    state = noisy(spark, hours(24 * 12)[::12])
    write_moments(state, BOX, OVERFLOW, f"{tmp_path}/m")
    assert len(spark.read.parquet(f"{tmp_path}/m/hours").inputFiles()) == 1
    assert read_run(spark, f"{tmp_path}/m").moments.length == 24
